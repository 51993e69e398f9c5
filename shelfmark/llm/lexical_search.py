"""Ranked lexical search: term at a time over short lists, document at a time over long ones.

Documents are read once for the terms of the items: their lengths, and how often each of these terms
occurs, go to the shared folder. From them come the corpus statistics (documents, terms, documents of
each term), and from those the weights, so that every score is final wherever it is computed.

The documents of a task are then searched in pieces of a fixed number of rows. In each piece an item's
short lists are added up into accumulators, term at a time. The accumulators, in document order, are one
more iterator whose bound is the largest sum; with the long lists it goes into a document-at-a-time
search: iterators in the order of their bounds, the first of which, as long as their bounds together
cannot reach the tenth best score, are only looked up for documents that others offer, and dropped
when what is left cannot reach it either. The tenth best score goes on from piece to piece.

Only the best of each task and item are shuffled. Items are taken in blocks of a bounded size in bytes, each
with a pass of its own, so that what is sent to every task is bounded.

Defined cases: a null text has no terms, and neither has an item without any: it gives no rows, as
do empty tables. Rows that share an item id (null is one) are one item with the terms of all of them.
Repeated documents are different documents; a null document id comes last among ties. Other columns
do not matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from shelfmark.llm.batches import small
from shelfmark.session import stage

PIECE = 8192  # documents whose lists are held together
SHORT_SHARE = 32  # lists of at most this part of a piece are short
STEP = 512  # documents that an iterator offers at a time
BLOCK_BYTES = 32 << 20  # bytes of item texts in a block
MOST = np.iinfo(np.int64).max
# A to Z become a to z, other ASCII characters that are no letter or digit become spaces.
TERMS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def terms(text: str | None) -> list[bytes]:
    return text.encode().translate(TERMS).split() if text else []


def search(iterators: list[tuple[np.ndarray, np.ndarray]], best: Best) -> None:
    """Offer every document that may be among the best; iterators are (documents ascending, scores > 0)."""
    its = sorted(((int(s.max()), d, s) for d, s in iterators if len(d)), key=lambda it: it[0])
    reach = np.cumsum([bound for bound, _, _ in its]).tolist()
    at = 0
    while True:
        floor = best.floor()
        needed = next((i for i, bound in enumerate(reach) if bound >= floor), len(its))
        if needed == len(its):
            return
        heads = []
        for _, docs, _ in its[needed:]:
            start = int(np.searchsorted(docs, at))
            if start < len(docs):
                heads.append(docs[start : start + STEP])
        if not heads:
            return
        # as far as every needed iterator has been read
        end = min((int(h[-1]) for h in heads if len(h) == STEP), default=MOST)
        found = np.unique(np.concatenate(heads))
        found = found[found <= end]
        total = np.zeros(len(found), np.int64)
        for i in range(len(its) - 1, -1, -1):
            stays = total + reach[i] >= floor
            found, total = found[stays], total[stays]
            _, docs, scores = its[i]
            place = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
            total += np.where(docs[place] == found, scores[place], 0)
        best.offer(found, total)
        if end == MOST:
            return
        at = end + 1


class Best:
    """The best documents of an item over the pieces of a task, by score, then by id."""

    def __init__(self, most: int):
        self.most = most
        self.kept: list[tuple] = []  # (-score, id is null, id)
        self.ids: pa.Array | None = None

    def floor(self) -> int:
        """A document with a lower score cannot enter."""
        return -self.kept[-1][0] if len(self.kept) == self.most else 1

    def offer(self, found: np.ndarray, total: np.ndarray) -> None:
        """Documents are numbered in the order of their ids."""
        enters = total >= self.floor()
        found, total = found[enters], total[enters]
        if not len(found):
            return
        order = np.lexsort((found, -total))[: self.most]
        for at in order:
            doc_id = self.ids[int(found[at])].as_py()
            self.kept.append((-int(total[at]), doc_id is None, doc_id))
        # stable, and a null id is never compared
        self.kept.sort(key=lambda e: (e[0], e[1], 0 if e[1] else e[2]))
        del self.kept[self.most :]


def hybrid(lists: list[tuple[np.ndarray, np.ndarray]], documents: int, best: Best) -> None:
    """One item against one piece: ``lists`` are (documents ascending, scores) of its terms."""
    short = [pair for pair in lists if len(pair[0]) * SHORT_SHARE <= documents]
    iterators = [pair for pair in lists if len(pair[0]) * SHORT_SHARE > documents]
    if short:
        sums = np.zeros(documents, np.int64)
        for docs, scores in short:  # a document is in a list once
            sums[docs] += scores
        held = np.flatnonzero(sums)
        iterators.append((held, sums[held]))
    search(iterators, best)


def lengths(n: np.ndarray, documents: int, every: int, b: int) -> np.ndarray:
    """The length part of a score in hundredths: 100 - b for none, 100 for an average document."""
    if len(n) and int(n.max()) * documents * b <= MOST:
        return 100 - b + (b * n * documents) // every
    return np.array([100 - b + (b * int(x) * documents) // every for x in n], np.int64)


def _count(wanted):
    """(id, n, terms, times) of each document with a term; only wanted terms are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = wanted.value
        for batch in small(batches):
            at, n, found, times = [], [], [], []
            for row, text in enumerate(batch.column(1)):
                words = terms(text.as_py())
                if not words:
                    continue
                own = [(numbers[w], c) for w, c in Counter(words).items() if w in numbers]
                at.append(row)
                n.append(len(words))
                found.append([t for t, _ in own])
                times.append([c for _, c in own])
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(at, pa.int64())), pa.array(n, pa.int64()),
                pa.array(found, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64())),
            ], ["id", "n", "terms", "times"])

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, PIECE):
            part = batch.slice(start, PIECE)
            if rows + part.num_rows > PIECE:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
            held.append(part)
            rows += part.num_rows
    if rows:
        yield pa.Table.from_batches(held)


def _searched(sent, most: int, k: int, b: int):
    """(item, id, score): the best documents of a task for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, items, documents, every = sent.value
        best, kind = [Best(most) for _ in items], None
        for piece in _pieces(batches):
            order = pc.sort_indices(piece, sort_keys=[("id", "ascending")], null_placement="at_end")
            piece = piece.take(order).combine_chunks()
            ids = piece.column("id").combine_chunks()
            kind = ids.type
            found = piece.column("terms").combine_chunks()
            numbers = found.flatten().to_numpy()
            times = piece.column("times").combine_chunks().flatten().to_numpy()
            doc = np.repeat(np.arange(len(ids)), pc.list_value_length(found).to_numpy())
            m = lengths(piece.column("n").to_numpy(), documents, every, b)[doc]
            scores = weights[numbers] * ((1_000_000_000 * times) // (1000 * times + k * m))
            positive = scores > 0
            numbers, doc, scores = numbers[positive], doc[positive], scores[positive]
            by_term = np.argsort(numbers, kind="stable")
            numbers, doc, scores = numbers[by_term], doc[by_term], scores[by_term]
            for wanted, heap in zip(items, best):
                starts, ends = np.searchsorted(numbers, wanted, "left"), np.searchsorted(numbers, wanted, "right")
                heap.ids = ids
                lists = [(doc[s:e], scores[s:e]) for s, e in zip(starts.tolist(), ends.tolist()) if e > s]
                if lists:
                    hybrid(lists, len(ids), heap)
        for start in range(0, len(best) if kind is not None else 0, 4096):
            told = [(item, entry) for item in range(start, min(start + 4096, len(best))) for entry in best[item].kept]
            yield pa.RecordBatch.from_arrays([
                pa.array([i for i, _ in told], pa.int32()), pa.array([e[2] for _, e in told], kind),
                pa.array([-e[0] for _, e in told], pa.int64()),
            ], ["item", "id", "score"])

    return run


def _block(documents: DataFrame, texts: list[tuple], most: int, k: int, b: int) -> tuple[DataFrame, list]:
    """(item, rank, id, score) for items (key, text) that fit in memory, and the keys by number."""
    spark = documents.sparkSession
    by_item: dict = {}
    for key, text in texts:
        by_item.setdefault(key, set()).update(terms(text))
    keys = sorted((key for key in by_item if by_item[key]), key=lambda key: (key is None, str(key)))
    words = sorted(set().union(*by_item.values()))
    numbers = {word: n for n, word in enumerate(words)}

    of_id = T.StructField("id", documents.schema["id"].dataType)
    numbered, counted = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())
    shape = T.StructType([of_id, T.StructField("n", T.LongType()), T.StructField("terms", numbered), T.StructField("times", counted)])
    wanted = spark.sparkContext.broadcast(numbers)
    postings = stage(documents.mapInArrow(_count(wanted), shape), "postings")
    total, every = postings.agg(F.count("*"), F.sum("n")).first()
    weights = np.zeros(len(words), np.int64)
    held = postings.select(F.explode("terms").alias("term")).groupBy("term").count()
    for term, df in held.collect():  # one row for each term of the block
        weights[term] = math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))
    items = [np.array(sorted(numbers[w] for w in by_item[key]), np.int64) for key in keys]
    sent = spark.sparkContext.broadcast((weights, items, total, every or 1))
    shape = T.StructType([T.StructField("item", T.IntegerType()), of_id, T.StructField("score", T.LongType())])
    found = postings.mapInArrow(_searched(sent, most, k, b), shape)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)
    return ranked, keys


def top_documents(
    documents: DataFrame,
    items: DataFrame,
    most: int = 10,
    k: int = 8,
    b: int = 90,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``most`` highest-scoring documents of each item.

    ``k`` hundredths of a term's saturation and ``b`` hundredths of its length normalisation.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    given = items.select(F.col(f"`{item_id}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    given = given.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    shape = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", items.schema[item_id].dataType)])
    out = None
    for number in range(blocks):
        texts = [tuple(r) for r in given.filter(F.col("block") == number).select("key", "text").collect()]
        ranked, keys = _block(docs, texts, most, k, b)
        names = spark.createDataFrame(list(enumerate(keys)), shape)
        told = ranked.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")
        out = told if out is None else out.union(told)
    return out
