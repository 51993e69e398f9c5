"""URL filter by hashed expressions, with DataFrame functions only.

A rule is a host and a path; it fits a URL of that host or any of its subdomains whose path
begins with the rule's path. Each distinct URL is expanded into the expressions host suffix plus
path prefix that could equal a rule: of the suffixes and prefixes only those with a number of
labels and a length that some rule has. Expressions meet rules by a short hash prefix, then the
full digest decides; of the fitting rules the longest wins (then the longer host, then block
before allow).

The expansion is decided per distinct URL, so that a URL on a third of all rows is expanded once;
the verdicts are joined back to the rows by URL, a join whose hot keys Spark splits at run time.

A null URL, and one without ``://``, has an empty host and path and fits no rule. An empty URL
table gives an empty result, an empty rule list the default verdict everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.llm.license_scan import LOWER, UPPER

# Hexadecimal digits of the short hash prefix: 32 bits.
PREFIX = 8

# Verdict, host, path.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without a host part."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) as literals of the plan."""
    if not rules:
        return spark.sql("SELECT '' AS verdict, '' AS host, '' AS path WHERE false")
    each = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]
    return spark.range(1).select(F.inline(F.array(*each)))


def verdicts(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Every row of ``urls`` with its columns, then host, path, rule and verdict.

    ``rules`` has (verdict, host, path). The shapes (number of host labels, path length) of the
    rules go into the plan as literals; a host has at most 127 labels, and a rule file has few
    path lengths, so there are at most some thousand. Columns of ``urls`` with one of the names
    of the result are replaced.
    """
    labels = F.size(F.split("host", r"\."))
    shapes = sorted(
        (r["labels"], r["chars"])
        for r in rules.select(labels.alias("labels"), F.char_length("path").alias("chars")).distinct().collect()
    )
    told = rules.select(
        F.col("verdict").alias("_verdict"),
        F.concat("host", "path").alias("_rule"),
        F.char_length("host").alias("_host_chars"),
        F.sha2(F.concat("host", F.lit("\n"), "path"), 256).alias("_rule_digest"),
    ).withColumn("_prefix", F.substring("_rule_digest", 1, PREFIX))

    distinct = urls.select(F.col(url_col).alias("_url")).distinct()
    parts = distinct.select(
        "_url", host_of(F.col("_url")).alias("_host"), path_of(F.col("_url")).alias("_path")
    )
    count = F.size(F.split("_host", r"\."))
    # an expression the URL is too short for is null, and dropped
    each = [
        F.when(
            (F.col("_host") != "") & (count >= n) & (F.char_length("_path") >= chars),
            F.concat(F.substring_index("_host", ".", -n), F.lit("\n"), F.substring("_path", 1, chars)),
        )
        for n, chars in shapes
    ]
    expressions = parts.select(
        "_url", F.explode(F.array_compact(F.array(*each) if each else F.array().cast("array<string>"))).alias("_expr")
    )
    digests = expressions.select("_url", F.sha2("_expr", 256).alias("_digest")).withColumn(
        "_prefix", F.substring("_digest", 1, PREFIX)
    )
    hits = digests.join(told, "_prefix").filter(F.col("_digest") == F.col("_rule_digest"))
    rank = F.struct(
        F.char_length("_rule"), "_host_chars", (F.col("_verdict") == "block").cast("int"), "_verdict"
    )
    best = hits.groupBy("_url").agg(F.max_by(F.struct("_rule", "_verdict"), rank).alias("_best"))
    best = best.withColumnRenamed("_url", "_best_url")

    own = ("host", "path", "rule", "verdict")
    kept = [c for c in urls.columns if c.lower() not in own]
    rows = urls.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(url_col).alias("_url"))
    joined = rows.join(best, F.col("_url").eqNullSafe(F.col("_best_url")), "left")
    return joined.select(
        *[F.col("_row").getField(c).alias(c) for c in kept],
        host_of(F.col("_url")).alias("host"),
        path_of(F.col("_url")).alias("path"),
        F.col("_best._rule").alias("rule"),
        F.coalesce(F.col("_best._verdict"), F.lit(default)).alias("verdict"),
    )
