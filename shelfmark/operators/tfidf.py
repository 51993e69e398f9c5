"""TF-IDF weights in long and packed form.

Counting happens inside each document's row, so tokens never cross the network: only the
distinct terms of a document do, once for the vocabulary (pre-aggregated by the map side) and
once when the kept terms of a document are gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfmark.functions import fixed, text as text_functions
from shelfmark.operators import heavy
from shelfmark.operators.spread import dense_numbers, spread_join
from shelfmark.session import passing, stage, widen

# Above this many terms the vocabulary is joined by shuffle instead of broadcast.
BROADCAST_TERMS = 200_000
ROWS_PER_TASK = 200_000


@dataclass(frozen=True)
class Vocabulary:
    """Which terms a model keeps: the ``max_features`` commonest of those in ``min_df`` documents or more.

    ``max_df``, a share of the documents, leaves out terms that are in more. It is off by default, as it
    changes results; it keeps the number of rows that meet in a similarity join down.
    """

    max_features: int | None = None
    min_df: int = 1
    max_df: float | None = None
    ngrams: tuple[int, int] = (1, 1)
    stop_words: tuple[str, ...] = fixed.ENGLISH_STOP_WORDS
    pattern: str = text_functions.WORD


NEAR_DUPLICATES = Vocabulary(max_features=3000, ngrams=(1, 2))
SPECIFIC = Vocabulary(
    max_features=3000, min_df=2, ngrams=(1, 2),
    stop_words=fixed.ENGLISH_STOP_WORDS + fixed.DOMAIN_STOP_WORDS,
)
PROSE = Vocabulary(
    max_features=4000, min_df=2, ngrams=(1, 2),
    stop_words=fixed.ENGLISH_STOP_WORDS + fixed.DOMAIN_STOP_WORDS,
)
CLUSTER_WORDS = Vocabulary(
    max_features=8000, min_df=5, pattern=text_functions.LETTER_RUN,
    stop_words=fixed.ENGLISH_STOP_WORDS + fixed.CLUSTER_STOP_WORDS,
)


def term_counts(docs: DataFrame, id_col: str, text: Column, terms: Vocabulary) -> DataFrame:
    """(id, counts): the terms of each document with their number of occurrences."""
    words = text_functions.tokens(text, terms.stop_words, terms.pattern)
    listed = widen(docs, id_col).select(F.col(id_col).alias("id"), words.alias("_words"))
    ordered = listed.select("id", F.sort_array(text_functions.ngrams(F.col("_words"), *terms.ngrams)).alias("_terms"))
    last = F.size("_terms") - 1
    starts = F.when(
        last >= 0,
        F.filter(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: (i == 0) | (F.get("_terms", i) != F.get("_terms", F.greatest(i - 1, F.lit(0)))),
        ),
    ).otherwise(F.array().cast("array<int>"))
    runs = ordered.select("id", "_terms", starts.alias("_starts"))
    counts = F.transform(
        F.col("_starts"),
        lambda at, k: F.struct(
            F.get("_terms", at).alias("term"),
            (F.coalesce(F.get("_starts", k + 1), F.size("_terms")) - at).alias("tf"),
        ),
    )
    return runs.select("id", counts.alias("counts"))


def vocabulary(counts: DataFrame, n_docs: int, terms: Vocabulary) -> DataFrame:
    """(term, df, occurrences, idf) of the kept terms.

    With ``max_features`` only the terms that may be among the most frequent are shuffled, where that
    can be proved to be enough.
    """
    most = float("inf") if terms.max_df is None else terms.max_df * n_docs
    used = None
    if terms.max_features is not None:
        used = heavy.most_frequent(counts, terms.max_features, terms.min_df, most)
    if used is None:
        used = (
            counts.select(F.inline("counts"))
            .groupBy("term")
            .agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))
        )
        if terms.min_df > 1 or terms.max_df is not None:
            used = used.filter(F.col("df").between(terms.min_df, F.lit(most)))
        if terms.max_features is not None:
            used = used.orderBy(F.desc("occurrences"), "term").limit(terms.max_features)
    idf = F.log(F.lit(1.0 + n_docs) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    return used.withColumn("idf", idf)


def indexed(kept: DataFrame, bounded: bool) -> DataFrame:
    """Number the kept terms 0, 1, ... with the rarest first.

    A bounded vocabulary is sorted in one task, another one by ranges.
    """
    if not bounded:
        numbered = dense_numbers(stage(kept, "vocabulary"), ("df", "term"), "idx")
        if (numbered.agg(F.max("idx")).first()[0] or 0) >= 2**31 - 1:
            raise ValueError("more terms than positions: set max_features or min_df")
        return numbered.withColumn("idx", F.col("idx").cast("int"))
    order = Window.partitionBy(F.lit(0)).orderBy("df", "term")
    return kept.withColumn("idx", (F.row_number().over(order) - 1).cast("int")).coalesce(1)


@dataclass(frozen=True)
class Model:
    """Vectors of one corpus and the terms behind their positions.

    ``vectors``: (id, idx array<int>, w array<double>) in index order, unit length (or empty);
    rarest terms come first. ``terms``: (idx, term, df, occurrences, idf); ``bounded`` if they are few
    enough to be broadcast.
    """

    vectors: DataFrame
    terms: DataFrame
    n_docs: int
    bounded: bool = True


def _join_terms(rows: DataFrame, kept: DataFrame, key: str, wanted: list[str], bounded: bool) -> DataFrame:
    """Rows (id, ...) with what is known of their terms; a term of many documents is dealt over several tasks."""
    if bounded:
        return rows.join(F.broadcast(kept.select(key, *wanted)), key)
    slices = F.ceil(F.col("df") / ROWS_PER_TASK).cast("int").alias("_slices")
    # written, so that the optimizer knows how few they are and does not shuffle all rows to look them up
    hot = stage(kept.filter(F.col("df") > ROWS_PER_TASK).select(key, slices), "hot-terms")
    return spread_join(rows, kept.select(key, *wanted), [key], ["id"], hot=hot)


def fit(docs: DataFrame, id_col: str, text: Column, terms: Vocabulary, label: str = "tfidf") -> Model:
    """Smooth-idf, L2-normalised TF-IDF vectors of every document."""
    bounded = terms.max_features is not None and terms.max_features <= BROADCAST_TERMS
    with passing(docs.sparkSession) as keep:
        counts = stage(term_counts(docs, id_col, text, terms), f"{label}-counts")
        n_docs = counts.count()
        with passing(docs.sparkSession) as keep_terms:
            kept = keep(keep_terms(stage(indexed(vocabulary(counts, n_docs, terms), bounded), f"{label}-terms")))
        found = _join_terms(counts.select("id", F.inline("counts")), kept, "term", ["idx", "idf"], bounded)
        entry = F.struct("idx", (F.col("tf") * F.col("idf")).alias("w"))
        # a document holds at most as many entries as it has terms
        gathered = found.groupBy("id").agg(F.array_sort(F.collect_list(entry)).alias("e"))
        norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda total, x: total + x["w"] * x["w"]))
        unit = text_functions.let(norm, lambda length: F.transform("e", lambda x: x["w"] / length))
        weighted = gathered.select("id", F.col("e.idx").alias("idx"), unit.alias("w"))
        vectors = keep(stage(weighted, f"{label}-vectors"))
    return Model(vectors, kept, n_docs, bounded)


def weights(model: Model) -> DataFrame:
    """Long form (id, term, weight)."""
    entries = model.vectors.select("id", F.inline(F.arrays_zip("idx", "w")))
    named = _join_terms(entries, model.terms, "idx", ["term"], model.bounded)
    return named.select("id", "term", F.col("w").alias("weight"))


def blend(first: Model, second: Model, first_weight: float, second_weight: float) -> DataFrame:
    """One vector per document whose dot product is the weighted sum of both cosines.

    Positions of the two vocabularies are merged so that rarer terms still come first.
    """
    def numbered(model: Model, side: int) -> DataFrame:
        return model.terms.select("idx", "df", "term", F.lit(side).alias("side"))

    bounded = first.bounded and second.bounded
    merged = numbered(first, 0).unionByName(numbered(second, 1))
    if bounded:
        order = Window.partitionBy(F.lit(0)).orderBy("df", "side", "term")
        place = merged.withColumn("place", (F.row_number().over(order) - 1).cast("int"))
    else:
        place = dense_numbers(merged, ("df", "side", "term"), "place").withColumn("place", F.col("place").cast("int"))

    def long(model: Model, side: int, weight: float) -> DataFrame:
        mine = place.filter(F.col("side") == side).select("idx", "place", "df")
        rows = model.vectors.select("id", F.inline(F.arrays_zip("idx", "w")))
        return _join_terms(rows, mine, "idx", ["place"], bounded).select(
            "id", F.col("place").alias("idx"), (F.col("w") * F.lit(weight**0.5)).alias("w")
        )

    both = long(first, 0, first_weight).unionByName(long(second, 1, second_weight))
    gathered = both.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("idx", "w"))).alias("e"))
    return gathered.select("id", F.col("e.idx").alias("idx"), F.col("e.w").alias("w"))
