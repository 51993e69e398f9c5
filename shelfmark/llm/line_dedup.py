"""Reversible line dedup: sharded cuckoo filters in front of an exact reference-count table.

The state is two tables. ``reference counts`` hold, for each line key, the number of documents it
is in; they decide. ``filters`` hold, for each shard of the keys, a cuckoo filter of the keys that
have reached the threshold; they only keep other lines away from the exact table. Cuckoo filters
can forget a key, so documents can be deleted again: ``insert`` and ``delete`` change the counts,
``update_filters`` carries over the keys that crossed the threshold either way.

``drop_lines`` reads a text, sends on only the digests of lines that a filter may hold, confirms
them in the exact table, and brings back for each document id the digests to drop. The filters
are broadcast only while they are within ``FILTER_BYTES``; beyond it digests are dealt to the shards,
with the same result. The join by digest may have hot keys (a line on a third of all
documents); Spark splits them at run time, and counts are combined before they are shuffled.

A line's key is the line without white space (space, tab to carriage return) at both ends, A-Z
lower-cased, as a 128-bit digest; empty keys count nowhere. A null text is one empty line. A
document is a row: repeated rows count each. Rows with one id, also null, are each given back.
Other columns are carried along, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from shelfmark.llm.batches import small
from shelfmark.session import stage, unstage

SPACE = b" \t\n\x0b\x0c\r"
THRESHOLD = 10
SHARD_KEYS = 250_000
FILTER_BYTES = 64 * 1024 * 1024
ASKED_IN = 8  # tasks that a shard's digests are dealt to, when filters stay where they are
SLOTS = 4
KICKS = 500


def line_digests(lines: list[bytes]) -> list[bytes]:
    """128-bit digest of each line's key; empty for an empty key."""
    digest = xxhash.xxh3_128_digest
    return [digest(key) if (key := line.strip(SPACE).lower()) else b"" for line in lines]


class Cuckoo:
    """A cuckoo filter of 16-byte digests: 16-bit fingerprints, four slots, two places."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.mask = len(table) - 1
        self.random = np.random.default_rng(len(table))

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        places = 1 << max(2, int(np.ceil(np.log2(max(keys, 1) / (SLOTS * 0.8)))))
        return cls(np.zeros((places, SLOTS), np.uint16))

    @classmethod
    def loaded(cls, blob: bytes) -> Cuckoo:
        return cls(np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy())

    def saved(self) -> bytes:
        return self.table.tobytes()

    def places(self, digests: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and the two places of each digest."""
        parts = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
        marks = (parts[:, 0] >> np.uint64(48)).astype(np.uint16)
        marks[marks == 0] = 1
        one = (parts[:, 1] & np.uint64(self.mask)).astype(np.int64)
        return marks, one, self.other(one, marks)

    def other(self, place, mark):
        return (place ^ (np.asarray(mark, np.int64) * 0x5BD1E995)) & self.mask

    def may_hold(self, digests: list[bytes]) -> np.ndarray:
        if not digests:
            return np.zeros(0, bool)
        marks, one, two = self.places(digests)
        return (self.table[one] == marks[:, None]).any(1) | (self.table[two] == marks[:, None]).any(1)

    def insert(self, digests: list[bytes]) -> bool:
        """False when there was no room; the filter is then not to be used any more."""
        for mark, one, two in zip(*self.places(digests)) if digests else ():
            for place in (one, two):
                free = np.flatnonzero(self.table[place] == 0)
                if len(free):
                    self.table[place, free[0]] = mark
                    break
            else:
                place = one
                for _ in range(KICKS):
                    slot = self.random.integers(SLOTS)
                    mark, self.table[place, slot] = self.table[place, slot], mark
                    place = self.other(place, mark)
                    free = np.flatnonzero(self.table[place] == 0)
                    if len(free):
                        self.table[place, free[0]] = mark
                        break
                else:
                    return False
        return True

    def delete(self, digests: list[bytes]) -> None:
        """Forget digests that were inserted."""
        for mark, one, two in zip(*self.places(digests)) if digests else ():
            for place in (one, two):
                held = np.flatnonzero(self.table[place] == mark)
                if len(held):
                    self.table[place, held[0]] = 0
                    break


# The exact table


def document_lines(docs: DataFrame, text_col: str, wholes: bool = False) -> DataFrame:
    """(digest) of each distinct line key of each row; with ``wholes`` also the digest ``whole`` of its text."""
    names = ["digest", "whole"] if wholes else ["digest"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            columns: list[list[bytes]] = [[] for _ in names]
            for text in batch.column(0):
                text = text.as_py() or b""
                own = {d for d in line_digests(text.split(b"\n")) if d}
                columns[0] += own
                if wholes:
                    columns[1] += [xxhash.xxh3_128_digest(text)] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], names)

    given = docs.select(F.col(f"`{text_col}`").cast("binary").alias("text"))
    return given.mapInArrow(run, ", ".join(f"{n} binary" for n in names))


def reference_counts(docs: DataFrame, text_col: str = "text", distinct_texts: bool = False) -> DataFrame:
    """(digest, n_docs): in how many rows, or distinct whole texts, a line key is found."""
    lines = document_lines(docs, text_col, distinct_texts)
    if distinct_texts:
        lines = lines.distinct()
    return lines.groupBy("digest").agg(F.count("*").alias("n_docs"))


def insert(counts: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The counts with the documents added."""
    both = counts.unionByName(reference_counts(docs, text_col))
    return both.groupBy("digest").agg(F.sum("n_docs").alias("n_docs"))


def delete(counts: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The counts without the documents, which must have been added before."""
    gone = reference_counts(docs, text_col).withColumn("n_docs", -F.col("n_docs"))
    both = counts.unionByName(gone)
    return both.groupBy("digest").agg(F.sum("n_docs").alias("n_docs")).filter("n_docs > 0")


# The filters


def _sharded(keys: DataFrame, shards: int) -> DataFrame:
    return keys.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))


def build_filters(counts: DataFrame, threshold: int = THRESHOLD, shards: int | None = None) -> DataFrame:
    """(shard, shards, filter) of the keys in at least ``threshold`` documents."""
    import pandas as pd

    heavy = counts.filter(F.col("n_docs") >= threshold).select("digest")
    if shards is None:
        shards = max(1, -(-heavy.count() // SHARD_KEYS))

    def build(part):
        digests = [bytes(d) for d in part["digest"]]
        size = len(digests)
        while not (made := Cuckoo.sized(size)).insert(digests):
            size *= 2
        return pd.DataFrame({"shard": [part["shard"].iloc[0]], "shards": [shards], "filter": [made.saved()]})

    return _sharded(heavy, shards).groupBy("shard").applyInPandas(build, "shard int, shards int, filter binary")


def update_filters(
    filters: DataFrame, before: DataFrame, after: DataFrame, threshold: int = THRESHOLD
) -> DataFrame:
    """The filters after a change of the counts: keys that crossed the threshold go in or out.

    A shard without room is left null: it may hold anything, until the filters are built anew.
    """
    import pandas as pd

    shards = filters.agg(F.max("shards")).first()[0] or 1
    old = before.filter(F.col("n_docs") >= threshold).select("digest", F.lit(-1).alias("way"))
    new = after.filter(F.col("n_docs") >= threshold).select("digest", F.lit(1).alias("way"))
    changed = old.unionByName(new).groupBy("digest").agg(F.sum("way").alias("way")).filter("way <> 0")

    def change(key, held, part):
        blob = held["filter"].iloc[0] if len(held) else Cuckoo.sized(SHARD_KEYS).saved()
        if blob is not None:
            made = Cuckoo.loaded(bytes(blob))
            made.delete([bytes(d) for d in part["digest"][part["way"] < 0]])
            blob = made.saved() if made.insert([bytes(d) for d in part["digest"][part["way"] > 0]]) else None
        return pd.DataFrame({"shard": [key[0]], "shards": [shards], "filter": [blob]})

    grouped = filters.groupBy("shard").cogroup(_sharded(changed, shards).groupBy("shard"))
    return grouped.applyInPandas(change, "shard int, shards int, filter binary")


def _digests(docs: DataFrame, id_col: str, text_col: str, keep) -> DataFrame:
    """(_id, digest) of the distinct line keys of each row, those of a piece of rows that ``keep`` chooses."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        chosen = keep()
        for batch in small(batches):
            places: list[int] = []
            found: list[bytes] = []
            for place, text in enumerate(batch.column(1)):
                own = {d for d in line_digests((text.as_py() or b"").split(b"\n")) if d}
                found += own
                places += [place] * len(own)
            at = chosen(found)
            ids = batch.column(0).take(pa.array([places[i] for i in at], pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([found[i] for i in at], pa.binary())], ["_id", "digest"])

    pair = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return pair.mapInArrow(run, _digest_shape(docs, id_col))


def _digest_shape(docs: DataFrame, id_col: str) -> T.StructType:
    return T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("digest", T.BinaryType())])


def may_be_heavy(docs: DataFrame, filters: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, digest) of the distinct line keys that the filters may hold.

    Filters of up to ``FILTER_BYTES`` are asked where the texts are. Larger ones stay where they are, and
    digests are dealt to them: a task holds the filter of one shard at a time.
    """
    size, shards = filters.agg(F.sum(F.length("filter")), F.max("shards")).first()
    shards = shards or 1
    if (size or 0) > FILTER_BYTES:
        return _asked_by_shard(docs, filters, id_col, text_col, shards)
    held = docs.sparkSession.sparkContext.broadcast({r["shard"]: r["filter"] and bytes(r["filter"]) for r in filters.collect()})

    def keep():
        loaded = {s: b and Cuckoo.loaded(b) for s, b in held.value.items()}

        def chosen(found: list[bytes]) -> list[int]:
            if not found:
                return []
            kept = np.zeros(len(found), bool)
            shard = np.array([_spark_hash(d) % shards for d in found]) if shards > 1 else np.zeros(len(found), int)
            for s in np.unique(shard).tolist():
                mine = np.flatnonzero(shard == s)
                if s in loaded:
                    kept[mine] = True if loaded[s] is None else loaded[s].may_hold([found[i] for i in mine])
            return np.flatnonzero(kept).tolist()

        return chosen

    return _digests(docs, id_col, text_col, keep)


def _asked_by_shard(docs: DataFrame, filters: DataFrame, id_col: str, text_col: str, shards: int) -> DataFrame:
    """Digests lined up behind the filter of their shard; a shard's digests are dealt to ``ASKED_IN`` tasks."""
    every = _digests(docs, id_col, text_col, lambda: lambda found: list(range(len(found))))
    shape = _digest_shape(docs, id_col)
    asked = _sharded(every, shards).select(
        "shard", F.pmod(F.xxhash64("digest", "_id"), F.lit(ASKED_IN)).cast("int").alias("task"), F.lit(False).alias("is_filter"),
        "_id", "digest",
    )
    held = filters.select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(ASKED_IN - 1))).alias("task"), F.lit(True).alias("is_filter"),
        F.lit(None).cast(shape["_id"].dataType).alias("_id"), F.col("filter").alias("digest"),
    )
    lined = held.unionByName(asked).repartition("shard", "task").sortWithinPartitions("shard", "task", F.desc("is_filter"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        own, made, whole = None, None, False  # the open shard, its filter, and whether it may hold anything
        for batch in batches:
            where = list(zip(*(batch.column(c).to_pylist() for c in (0, 1))))
            marks, kept = batch.column(2).to_pylist(), []
            starts = [i for i in range(len(where)) if i == 0 or where[i] != where[i - 1]]
            for start, end in zip(starts, [*starts[1:], len(where)]):
                if where[start] != own:
                    own, made, whole = where[start], None, False
                if marks[start]:
                    blob = batch.column(4)[start].as_py()
                    made, whole, start = blob and Cuckoo.loaded(blob), blob is None, start + 1
                asked_here = batch.column(4).slice(start, end - start).to_pylist()
                if whole:
                    kept += range(start, end)
                elif made is not None and asked_here:
                    kept += (start + np.flatnonzero(made.may_hold(asked_here))).tolist()
            rows = batch.take(pa.array(kept, pa.int32()))
            yield pa.RecordBatch.from_arrays([rows.column(3), rows.column(4)], ["_id", "digest"])

    return lined.mapInArrow(run, shape)


def _spark_hash(digest: bytes) -> int:
    """Spark's xxhash64 of a binary value, as a signed number."""
    value = xxhash.xxh64_intdigest(digest, 42)
    return value - (1 << 64) if value >> 63 else value


def drop_lines(
    docs: DataFrame,
    counts: DataFrame,
    filters: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: int = THRESHOLD,
) -> DataFrame:
    """Every row with its columns, the text without lines found in ``threshold`` documents or more,
    and the numbers ``n_lines`` (before) and ``n_dropped``."""
    heavy = counts.filter(F.col("n_docs") >= threshold).select("digest")
    doomed = may_be_heavy(docs, filters, id_col, text_col).join(heavy, "digest")
    by_id = doomed.groupBy("_id").agg(F.collect_set("digest").alias("_doomed"))
    own = ("n_lines", "n_dropped")
    kept = [c for c in docs.columns if c.lower() not in own]
    rows = docs.select(
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in kept if c != text_col]).alias("_row"),
        F.col(f"`{id_col}`").alias("_row_id"), F.col(f"`{text_col}`").cast("binary").alias("_text"),
    )
    joined = rows.join(by_id, F.col("_row_id").eqNullSafe(F.col("_id")), "left").select("_row", "_text", "_doomed")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts, lines, drops = [], [], []
            for text, doomed in zip(batch.column(1), batch.column(2)):
                told = (text.as_py() or b"").split(b"\n")
                gone = set(doomed.as_py() or ())
                stay = [x for x, d in zip(told, line_digests(told)) if d not in gone] if gone else told
                texts.append(b"\n".join(stay).decode() if text.is_valid else None)
                lines.append(len(told))
                drops.append(len(told) - len(stay))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(drops, pa.int64())],
                ["_row", "_text", "n_lines", "n_dropped"],
            )

    counted = [T.StructField(n, T.LongType()) for n in own]
    out = joined.mapInArrow(run, T.StructType([rows.schema["_row"], T.StructField("_text", T.StringType()), *counted]))
    back = [F.col("_text").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in kept]
    return out.select(*back, "n_lines", "n_dropped")


def dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, distinct_texts: bool = False
) -> DataFrame:
    """``drop_lines`` of documents against their own counts.

    With ``distinct_texts`` copies of a whole text count once, so that they keep their lines.
    """
    counts = stage(reference_counts(docs, text_col, distinct_texts), "line-counts")
    filters = stage(build_filters(counts, threshold), "line-filters")
    return drop_lines(docs, counts, filters, id_col, text_col, threshold)


def dedup_with_changes(
    docs: DataFrame, changed: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD
) -> DataFrame:
    """``drop_lines`` of documents against a state that has lost the ``changed`` ones and got them back.

    The counts of all documents are kept, not only those over the threshold, as a deletion can bring a
    line below it and an insertion above it. The result equals that of ``dedup``.
    """
    counts = stage(reference_counts(docs, text_col), "line-counts")
    filters = stage(build_filters(counts, threshold), "line-filters")
    less = stage(delete(counts, changed, text_col), "line-counts")
    smaller = stage(update_filters(filters, counts, less, threshold), "line-filters")
    again = stage(insert(less, changed, text_col), "line-counts")
    larger = stage(update_filters(smaller, less, again, threshold), "line-filters")
    unstage(counts, filters, smaller)
    return drop_lines(docs, again, larger, id_col, text_col, threshold)
