"""License scan by diagonal voting, with DataFrame functions only.

Every rolling word k-gram of a text is joined by hash to the places it has in the templates. A
match votes for the diagonal (place in the text minus place in the template); votes on one
diagonal are a verbatim run, neighbouring diagonals are the same passage with a few words put in
or left out. Merged diagonals are verified span by span.

The exploded grams never cross the network: templates are literals of the plan, a few hundred
rows, so that Spark broadcasts them by their known size; only the matches are shuffled, once, by
document.

Nulls, empty texts and texts shorter than k words have no matches. Repeated rows each get their
own result, rows equal in key and text the same one; a null key is a key like any other. Other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfmark.functions.text import let, ngrams

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEY = ["_id", "_digest"]


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    exact: bool = False  # found only word for word


# Phrases that are found word for word, and well-known license sentences.
PHRASES = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
)
SENTENCES = (
    Template("apache", "licensed under the apache license version 2 0"),
    Template("apache", "you may not use this file except in compliance with the license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("gpl", "licensed under the gnu general public license version 3"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("mit", "released under the mit license"),
    Template("mpl", "subject to the terms of the mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)


def words(text: Column) -> Column:
    """Words of the text: runs of digits, letters and anything outside ASCII, in lower case.

    lower() is quick but lowers more than A-Z. Templates are ASCII, and the only other character
    that it turns into ASCII alone is the Kelvin sign, which is put out of the way.
    """
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u212b"))
    return F.array_remove(F.split(F.lower(plain), NOT_WORD), "")


def template_grams(spark, templates: Sequence[Template], k: int) -> DataFrame:
    """One row per k-gram of each template, from literals."""
    rows = []
    for number, t in enumerate(templates):
        w = t.text.split()
        if not t.text.isascii():
            raise ValueError(f"template {t.text!r} is not ASCII")
        if len(w) < k:
            raise ValueError(f"template {t.text!r} has fewer than {k} words")
        for place in range(len(w) - k + 1):
            rows.append((number, t.label, t.exact, len(w) - k + 1, place, " ".join(w[place : place + k])))
    names = ("_template", "_label", "_exact", "_size", "_place", "_gram")
    values = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])
    return spark.range(1).select(F.inline(values)).withColumn("_hash", F.xxhash64("_gram"))


def _passages(docs: DataFrame, id_col: str, text_col: str, templates: Sequence[Template], k: int, gap: int) -> DataFrame:
    """Merged diagonals by text and template, and for each text a row of template -1.

    Every gram list starts with an empty gram, which meets no template: its row stands for the
    text, so that texts without a match and repeated rows come out of the same single pass.
    """
    listed = docs.select(
        F.col(id_col).alias("_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_digest"),
        words(F.col(text_col)).alias("_w"),
    ).select(
        *KEY,
        F.size("_w").cast("long").alias("_n_words"),
        F.concat(F.array(F.lit("")), let(F.col("_w"), lambda w: ngrams(w, k, k))).alias("_grams"),
    )
    grams = listed.select(*KEY, "_n_words", F.posexplode_outer("_grams").alias("_pos", "_found"))
    places = template_grams(docs.sparkSession, templates, k)
    hashed = grams.withColumn("_hash", F.xxhash64("_found"))
    # equal, said so that it stays a check behind the join by hash
    equal = F.contains(hashed["_found"], places["_gram"]) & (F.length(hashed["_found"]) <= F.length(places["_gram"]))
    met = (
        hashed.join(places, (hashed["_hash"] == places["_hash"]) & equal, "left")
        .filter(F.col("_template").isNotNull() | (F.col("_pos") == 0))
        .select(
            *KEY, "_n_words", F.coalesce("_template", F.lit(-1)).alias("_template"), "_label",
            F.coalesce("_exact", F.lit(False)).alias("_exact"), "_size",
            F.coalesce("_place", F.lit(0)).alias("_place"), (F.col("_pos") - 1).alias("_pos"),
        )
        .repartition(*KEY)
    )
    by = [*KEY, "_template", "_label", "_exact", "_size"]
    diagonals = (
        met.withColumn("_diagonal", F.col("_pos") - F.col("_place"))
        .groupBy(*by, "_diagonal")
        .agg(
            F.collect_set("_place").alias("_places"), F.min("_pos").alias("_first"), F.max("_pos").alias("_last"),
            F.count("*").alias("_rows"), F.max("_n_words").alias("_n_words"),
        )
        .filter(~F.col("_exact") | (F.size("_places") == F.col("_size")))
    )
    along = Window.partitionBy(*KEY, "_template").orderBy("_diagonal")
    apart = F.col("_diagonal") - F.lag("_diagonal").over(along)
    starts = (F.col("_exact") | apart.isNull() | (apart > gap)).cast("int")
    return (
        diagonals.withColumn("_starts", starts)
        .withColumn("_band", F.sum("_starts").over(along))
        .groupBy(*by, "_band")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("_places")))).alias("_voted"),
            F.min("_first").alias("_first"),
            F.max("_last").alias("_last"),
            F.sum("_rows").alias("_rows"),
            F.max("_n_words").alias("_n_words"),
        )
    )


def _verified(k: int, coverage: float) -> Column:
    """Enough of the template, in a span at most half as long again as the template."""
    length, size = F.col("_last") + k - F.col("_first"), F.col("_size") + (k - 1)
    return (F.col("_voted") / F.col("_size") >= coverage) & (length * 2 <= size * 3)


def scan(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    templates: Sequence[Template] = PHRASES + SENTENCES,
    k: int = 2,
    gap: int = 2,
    coverage: float = 0.8,
) -> DataFrame:
    """Verified spans: (_id, _digest, template, label, exact, first_word, last_word, coverage).

    ``_id`` and ``_digest`` (hash of the text) name the text. Diagonals at most ``gap`` apart are
    merged. A span is kept when it has at least ``coverage`` of the template's k-grams (exact
    templates: all of them on one diagonal) and is at most half as long again as the template.
    """
    return _passages(docs, id_col, text_col, templates, k, gap).filter(_verified(k, coverage)).select(
        *KEY,
        F.col("_template").alias("template"),
        F.col("_label").alias("label"),
        F.col("_exact").alias("exact"),
        F.col("_first").cast("long").alias("first_word"),
        (F.col("_last") + (k - 1)).cast("long").alias("last_word"),
        (F.col("_voted") / F.col("_size")).alias("coverage"),
    )


def licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Sequence[Template] = PHRASES + SENTENCES,
    k: int = 2,
    gap: int = 2,
    coverage: float = 0.8,
) -> DataFrame:
    """One row per input row: the exact phrases found, all labels, and the best coverage."""
    all_rows = _passages(docs, id_col, text_col, templates, k, gap)
    text = F.col("_template") == -1
    good = _verified(k, coverage)
    phrase = good & F.col("_exact")
    found = all_rows.groupBy(*KEY).agg(
        F.max(F.when(text, F.col("_n_words"))).alias("n_words"),
        F.sum(F.when(text, F.col("_rows"))).cast("int").alias("_copies"),
        F.count(F.when(phrase, 1)).alias("n_base"),
        F.min(F.when(phrase, F.col("_first"))).cast("long").alias("first_word"),
        F.max(F.when(phrase, F.col("_first"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(phrase, F.col("_label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(good, F.col("_label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(good, F.col("_voted") / F.col("_size"))), F.lit(0.0)).alias("score"),
    )
    return found.select(
        F.col("_id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
        F.explode(F.array_repeat(F.lit(0), F.col("_copies"))).alias("_copy"),
    ).drop("_copy")
