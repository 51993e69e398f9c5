"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.llm import (
    bpe_stream, hard_negatives, html_density, lexical_search, license_scan, line_dedup, mixing, ngram_join, packing,
    quality, simhash, token_counts, url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/pages.parquet")


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op1_text_density(spark, sf):
    found = html_density.extract(pages(spark, sf).select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


@query
def op2_simhash(spark, sf):
    """Fingerprints, and for each hundredth document the number of rows within three bits of its own."""
    told = simhash.edited(documents(spark, sf))
    return simhash.counted_within(told, F.col("doc_id") % 100 == 0)


@query
def op6_fertility(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text", "lang")
    measured = quality.measures(docs, tokenizer("piece_bpe_32k.model"), bands=quality.FITTED)
    return measured.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_tokens", "chars_per_token", "byte_share", "token_entropy", "band",
    )


@query
def op4_license_scan(spark, sf):
    return license_scan.licenses(documents(spark, sf))


def _template_rows() -> str:
    rows = []
    for n, t in enumerate(license_scan.PHRASES + license_scan.SENTENCES):
        rows.append(f"({n}, '{t.label}', {str(t.exact).lower()}, '{t.text}')")
    return ", ".join(rows)


SQL["op4_license_scan"] = rf"""
WITH templates AS (
  SELECT t, label, exact, string_split(phrase, ' ') AS w
  FROM (VALUES {_template_rows()}) v(t, label, exact, phrase)),
places AS (
  SELECT t, label, exact, len(w) - 1 AS size, place, w[place + 1] || ' ' || w[place + 2] AS gram
  FROM (SELECT *, unnest(range(len(w) - 1)) AS place FROM templates)),
worded AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
grams AS (
  SELECT r, pos, w[pos + 1] || ' ' || w[pos + 2] AS gram
  FROM (SELECT r, w, unnest(range(len(w) - 1)) AS pos FROM worded)),
diagonals AS (
  SELECT r, t, label, exact, size, pos - place AS diagonal, list(DISTINCT place) AS places,
         min(pos) AS first, max(pos) AS last
  FROM grams JOIN places USING (gram)
  GROUP BY ALL HAVING NOT exact OR count(DISTINCT place) = size),
flagged AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, t ORDER BY diagonal) <= 2 AND NOT exact
                 THEN 0 ELSE 1 END AS starts
  FROM diagonals),
banded AS (SELECT *, sum(starts) OVER (PARTITION BY r, t ORDER BY diagonal) AS band FROM flagged),
merged AS (
  SELECT r, t, label, exact, size, band, len(list_distinct(flatten(list(places)))) AS voted,
         min(first) AS first, max(last) AS last
  FROM banded GROUP BY r, t, label, exact, size, band),
spans AS (
  SELECT *, voted::DOUBLE / size AS coverage FROM merged
  WHERE voted::DOUBLE / size >= 0.8 AND (last + 2 - first) * 2 <= (size + 1) * 3),
found AS (
  SELECT r, count(*) FILTER (exact) AS n_base, min(first) FILTER (exact) AS first_word,
         max(first) FILTER (exact) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score
  FROM spans GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0.0)::DOUBLE AS score
FROM worded LEFT JOIN found USING (r)
"""


@query
def op5_url_filter(spark, sf):
    rules = url_filter.rule_table(spark, url_filter.RULES)
    told = url_filter.verdicts(pages(spark, sf).select("page_id", "url"), rules)
    return told.select("page_id", "host", "path", "rule", "verdict")


SQL["op5_url_filter"] = rf"""
WITH rules(verdict, host, path) AS (VALUES {", ".join(str(r) for r in url_filter.RULES)}),
parts AS (
  SELECT page_id, row_number() OVER () AS r,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
                   '{license_scan.UPPER}', '{license_scan.LOWER}') AS h,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS p
  FROM pages),
fits AS (
  SELECT r, host || path AS rule, verdict,
         row_number() OVER (PARTITION BY r ORDER BY length(host || path) DESC, length(host) DESC,
                            verdict = 'block' DESC) AS place
  FROM parts JOIN rules ON (h = host OR ends_with(h, '.' || host)) AND starts_with(p, path))
SELECT page_id, h AS host, p AS path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN fits ON parts.r = fits.r AND place = 1
"""


@query
def op7_stream_bpe(spark, sf):
    return bpe_stream.encode_documents(documents(spark, sf), tokenizer("word_bpe_49k.json"))


@query
def op9_token_counts(spark, sf):
    counted = token_counts.token_counts(documents(spark, sf), tokenizer("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


@query
def op3_line_dedup(spark, sf):
    """Documents against a state that lost each hundredth one and got it back."""
    docs = documents(spark, sf).select("doc_id", "text")
    kept = line_dedup.dedup_with_changes(docs, docs.filter(F.col("doc_id") % 100 == 0))
    return kept.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


SQL["op3_line_dedup"] = """
WITH split AS (
  SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
keyed AS (
  SELECT doc_id, r, lines, list_transform(lines, lambda l: translate(
    trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS keys FROM split),
heavy AS (
  SELECT key FROM (SELECT DISTINCT r, unnest(keys) AS key FROM keyed) WHERE length(key) >= 1
  GROUP BY key HAVING count(*) >= 10),
each AS (SELECT doc_id, r, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line, unnest(keys) AS key FROM keyed),
told AS (SELECT e.*, h.key IS NOT NULL AS dropped FROM each e LEFT JOIN heavy h ON e.key = h.key)
SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM (
  SELECT doc_id, r, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
         sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
  FROM told GROUP BY doc_id, r)
"""


@query
def op10_ngram_jaccard(spark, sf):
    return ngram_join.linked(documents(spark, sf), words_each=4, threshold=(85, 100))


SQL["op10_ngram_jaccard"] = rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'),
                            '[^\x20\x09-\x0D]+') AS w
  FROM documents),
grams AS (
  SELECT DISTINCT r, array_to_string(list_slice(w, i, i + 3), ' ') AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM worded WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
met AS (SELECT x.r AS a, y.r AS b, count(*) AS shared FROM grams x JOIN grams y ON x.g = y.g AND x.r <> y.r GROUP BY x.r, y.r),
links AS (
  SELECT a, b FROM met JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b
  WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reach(r, q) AS (SELECT a, b FROM links UNION SELECT reach.r, links.b FROM reach JOIN links ON reach.q = links.a),
least AS (SELECT reach.r, min(doc_id) AS m FROM reach JOIN worded ON worded.r = q GROUP BY reach.r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM worded LEFT JOIN sizes USING (r) LEFT JOIN least USING (r)
"""


# Target mix of the query: parameters.
MIX_WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}
MIX_SHARE = 0.75
MIX_EPOCHS = 2
MIX_SEED = 17


def domain(source):
    """Four domains of sources, by the number in a source's name; none without a number."""
    number = F.regexp_extract(source, r"(\d+)", 1)
    return F.when(number != "", F.concat(F.lit("d"), F.pmod(number.cast("long"), F.lit(4)).cast("string")))


@query
def op8_mix_sources(spark, sf):
    docs = documents(spark, sf).withColumn("domain", domain(F.col("source")))
    mixed = mixing.mix(docs, ["domain", "lang", "source"], MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)
    return mixed.select("doc_id", "domain", "lang", "source", "mix_tokens", "mix_budget", "mix_times")


def _case(column: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{v}' THEN {w}" for v, w in MIX_WEIGHTS[column].items()) + " ELSE 1 END"


def _shared(name: str, nodes: str, parent: str) -> str:
    """CTEs that fill up the children in ``nodes`` (keys, capacity, weight, parent_budget, own)."""
    by = f"PARTITION BY {parent}" if parent else ""
    order = f"{by} ORDER BY CASE WHEN weight > 0 THEN capacity / weight END NULLS LAST, own"
    return f"""
{name}_placed AS (
  SELECT *, row_number() OVER ({order}) AS place,
    parent_budget - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
    sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM ({nodes})),
{name}_marked AS (
  SELECT *, min(place) FILTER (capacity::HUGEINT * weights > weight::HUGEINT * greatest(remaining, 0)) OVER ({by}) AS opened
  FROM {name}_placed),
{name}_known AS (
  SELECT *, (max(remaining) FILTER (place = opened) OVER ({by}))::HUGEINT AS rest,
    (max(weights) FILTER (place = opened) OVER ({by}))::HUGEINT AS every FROM {name}_marked),
{name} AS (
  SELECT * EXCLUDE (parent_budget), CASE WHEN opened IS NULL OR place < opened THEN capacity
    WHEN every > 0 THEN greatest(least(
      (rest * (every - weights + weight)) // every - (rest * (every - weights)) // every, capacity), 0)
    ELSE 0 END AS budget FROM {name}_known)"""


_TOP = f"""SELECT domain, domain AS own, sum(capacity) AS capacity, {_case("domain")} AS weight,
  (SELECT floor({MIX_SHARE} * sum(tokens))::HUGEINT FROM leaves) AS parent_budget FROM leaves GROUP BY domain"""
_MIDDLE = f"""SELECT l.domain, lang, lang AS own, sum(l.capacity) AS capacity, {_case("lang")} AS weight,
  any_value(budget) AS parent_budget FROM leaves l JOIN top t ON l.domain IS NOT DISTINCT FROM t.domain
  GROUP BY l.domain, lang"""
_BOTTOM = """SELECT l.domain, l.lang, source, source AS own, sum(l.capacity) AS capacity, 1 AS weight,
  any_value(budget) AS parent_budget FROM leaves l JOIN middle m
  ON l.domain IS NOT DISTINCT FROM m.domain AND l.lang IS NOT DISTINCT FROM m.lang
  GROUP BY l.domain, l.lang, source"""

SQL["op8_mix_sources"] = rf"""
WITH docs AS (
  SELECT doc_id, lang, source, coalesce(doc_id::VARCHAR, '') AS named, row_number() OVER () AS r,
    CASE WHEN regexp_matches(source, '\d') THEN 'd' || (regexp_extract(source, '\d+')::BIGINT % 4) END AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::HUGEINT AS tokens, {MIX_EPOCHS} * sum(tokens)::HUGEINT AS capacity
           FROM docs GROUP BY ALL),
{_shared("top", _TOP, "").strip()},
{_shared("middle", _MIDDLE, "domain").strip()},
{_shared("bottom", _BOTTOM, "domain, lang").strip()},
told AS (
  SELECT d.*, budget, CASE WHEN l.tokens > 0 THEN budget // l.tokens ELSE {MIX_EPOCHS} END AS whole,
         CASE WHEN l.tokens > 0 THEN budget % l.tokens ELSE 0 END AS rest
  FROM docs d JOIN bottom b ON d.domain IS NOT DISTINCT FROM b.domain AND d.lang IS NOT DISTINCT FROM b.lang
    AND d.source IS NOT DISTINCT FROM b.source
  JOIN leaves l ON d.domain IS NOT DISTINCT FROM l.domain AND d.lang IS NOT DISTINCT FROM l.lang
    AND d.source IS NOT DISTINCT FROM l.source),
ordered AS (
  SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY md5('{MIX_SEED}:' || whole || ':' || named) || ':' || named) AS upto FROM told)
SELECT doc_id, domain, lang, source, tokens::BIGINT AS mix_tokens, budget::BIGINT AS mix_budget,
  (whole + CASE WHEN whole < {MIX_EPOCHS} AND upto <= rest THEN 1 ELSE 0 END)::INTEGER AS mix_times
FROM ordered
"""


@query
def op11_hard_negatives(spark, sf):
    """Three negatives for each of five positives of every fiftieth vector; every seventh label is moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("id") % 50 == 0, label)


SQL["op11_hard_negatives"] = """
WITH moved AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings),
sound AS (
  SELECT DISTINCT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM moved
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
numbered AS (SELECT *, row_number() OVER () AS r FROM sound),
cells AS (SELECT r, vec_id, label, unnest(v) AS x, unnest(range(len(v))) AS i FROM numbered),
anchors AS (SELECT * FROM cells WHERE vec_id % 50 = 0),
scored AS (
  SELECT a.r AS a, c.r AS c, a.vec_id AS anchor_id, c.vec_id AS other, a.label = c.label AS same, sum(a.x * c.x)::BIGINT AS score
  FROM anchors a JOIN cells c ON a.i = c.i AND a.r <> c.r GROUP BY ALL),
positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, other) AS place FROM scored WHERE same)
  WHERE place <= 5),
negatives AS (
  SELECT p.anchor_id, p.other AS positive_id, p.score AS positive_score, n.other AS negative_id, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.c ORDER BY n.score DESC, n.other) AS rank
  FROM positives p JOIN scored n ON p.a = n.a AND NOT n.same
  WHERE 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 3
"""


@query
def op12_lexical_search(spark, sf):
    return lexical_search.top_documents(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


SQL["op12_lexical_search"] = rf"""
WITH worded AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
sizes AS (SELECT doc_id, r, len(w)::BIGINT AS n FROM worded WHERE len(w) > 0),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS every FROM sizes),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
counted AS (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM worded)
  WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weighed AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM counted GROUP BY term), totals),
parts AS (
  SELECT term, r, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // every))) AS part
  FROM counted JOIN weighed USING (term) JOIN sizes USING (r), totals),
summed AS (SELECT item_id, r, sum(part)::BIGINT AS score FROM asked JOIN parts USING (term) GROUP BY item_id, r),
ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM summed JOIN sizes USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query
def op13_pack_sequences(spark, sf):
    pieces = packing.packed(documents(spark, sf), tokenizer("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
