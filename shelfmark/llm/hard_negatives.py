"""Hard-negative mining: integer products of tiles by Strassen's recursion, then mergeable heaps.

Vectors become whole numbers and are packed into tiles of a fixed size in bytes. The inner products
of a tile of anchors with a tile of candidates are one product of matrices, computed by Strassen's
recursion in 64-bit integers, where additions are exact; matrices are padded with zeros to even sides.

First pass: rows of one label meet, and every anchor keeps a heap of its best positives. Second pass:
each anchor has a window of scores for each positive, and keeps a heap of the best rows of other
labels inside it. Heaps of one anchor from different tasks merge by their scores, ties by id.

A label with more rows than a tile holds has tiles of its own, smaller labels share tiles whole; so
the first pass multiplies little more than the pairs of one label, however large one label is. Tiles
meet in a grid: candidates are dealt to slices and repeated for each group of anchor blocks, anchor blocks the other
way round, with as many cells as the work needs. Nothing is broadcast, and a task holds two tiles and
the heaps of one block of anchors at a time.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no
part. Repeated rows (id, label and vector) count once; rows that share an id alone are different rows.
A null id is no anchor, and comes last among ties. Shorter vectors are filled up with zeros. Scaled
components beyond 64 bits become the nearest 64-bit number, products and sums are taken modulo 2^64.
Anchors without positives and windows without rows give no rows; so does an empty table. Other
columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.session import stage

CANDIDATE_BYTES = 1 << 18
ANCHOR_BYTES = 1 << 18
LEAST_ROWS = 16
PAIRS_PER_CELL = 64
LEAF = 16  # sides up to this are multiplied plainly
LEAST = np.iinfo(np.int64).min
MOST = np.iinfo(np.int64).max


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two int64 matrices, modulo 2^64."""
    (m, k), n = a.shape, b.shape[1]
    depth = 0
    while min(m, k, n) >> depth > LEAF:
        depth += 1
    if depth == 0:
        return a @ b
    unit = 1 << depth
    sides = [-side // unit * -unit for side in (m, k, n)]
    padded_a = np.zeros((sides[0], sides[1]), np.int64)
    padded_b = np.zeros((sides[1], sides[2]), np.int64)
    padded_a[:m, :k], padded_b[:k, :n] = a, b
    return _seven(padded_a, padded_b, depth)[:m, :n]


def _seven(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Seven products of quarters instead of eight."""
    if depth == 0:
        return a @ b
    m, k, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    down = depth - 1
    out = np.empty((2 * m, 2 * n), np.int64)
    one = _seven(a11 + a22, b11 + b22, down)
    four = _seven(a22, b21 - b11, down)
    five = _seven(a11 + a12, b22, down)
    out[:m, :n] = one + four - five + _seven(a12 - a22, b21 + b22, down)
    two = _seven(a21 + a22, b11, down)
    three = _seven(a11, b12 - b22, down)
    out[:m, n:] = three + five
    out[m:, :n] = two + four
    out[m:, n:] = one - two + three + _seven(a21 - a11, b11 + b12, down)
    return out


class Heaps:
    """The best entries of each of many rows, by score, then by id (none last)."""

    def __init__(self, rows: int, most: int):
        self.most = most
        self.floor = np.full(rows, LEAST)  # an entry below it cannot enter
        self.kept = tuple(np.empty(0, np.int64) for _ in range(4))  # row, ~score, none, id

    def offer(self, scores: np.ndarray, allowed: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        """Scores of every row with the same candidates, which are ordered by (none, id)."""
        count = scores.shape[1]
        floor = self.floor
        if count > self.most:
            held = np.where(allowed, scores, LEAST)
            floor = np.maximum(floor, np.partition(held, count - self.most, axis=1)[:, count - self.most])
        enters = allowed & (scores >= floor[:, None])
        if np.count_nonzero(enters) > 4 * self.most * len(floor):
            # many ties: of those at the floor only the first ones can stay
            ties = enters & (scores == floor[:, None])
            enters &= ~ties | (np.cumsum(ties, axis=1) <= self.most)
        row, at = np.nonzero(enters)
        if not len(row):
            return
        new = (row, ~scores[row, at], none[at], ids[at])
        row, inverse, none, ids = (np.concatenate(pair) for pair in zip(self.kept, new))
        order = np.lexsort((ids, none, inverse, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        order = order[place < self.most]
        self.kept = tuple(part[order] for part in (np.concatenate(p) for p in zip(self.kept, new)))
        last = row[place == self.most - 1]
        self.floor[last] = ~inverse[order][(place[place < self.most]) == self.most - 1]

    def lists(self) -> Iterator[tuple[int, list[dict]]]:
        """(row, entries in order) of the rows that have any."""
        row, inverse, none, ids = self.kept
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else []
        for start, end in zip(starts, [*starts[1:], len(row)]):
            entries = zip(inverse[start:end].tolist(), none[start:end].tolist(), ids[start:end].tolist())
            yield int(row[start]), [{"inverse": s, "none": n, "id": i} for s, n, i in entries]


HEAP = "array<struct<inverse: bigint, none: bigint, id: bigint>>"
HEAP_TYPE = pa.list_(pa.struct([("inverse", pa.int64()), ("none", pa.int64()), ("id", pa.int64())]))
TILE = "ids array<bigint>, labels array<string>, vectors binary"


def clean(rows: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """(id, label, v): the rows that take part, with whole numbers."""
    plain = rows.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("string").alias("label"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("x"),
    )
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    sound = plain.filter(F.col("label").isNotNull() & F.col("x").isNotNull() & finite)
    return sound.select("id", "label", F.transform("x", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def _pack(dims: int, keys: list[str]):
    """Rows of one tile, without repeats, ordered by id, as one row."""

    def run(table: pa.Table) -> pa.Table:
        seen = {}
        for i, label, v in zip(*(table.column(c).to_pylist() for c in ("id", "label", "v"))):
            seen[(i is None, i or 0, label, tuple(v))] = None
        rows = sorted(seen)
        matrix = np.zeros((len(rows), dims), np.int64)
        for at, row in enumerate(rows):
            matrix[at, : len(row[3])] = row[3]
        out = {k: [table.column(k)[0].as_py()] for k in keys}
        out |= {"ids": [[None if r[0] else r[1] for r in rows]], "labels": [[r[2] for r in rows]], "vectors": [matrix.tobytes()]}
        kinds = {"family": pa.string(), "block": pa.int64(), "ids": pa.list_(pa.int64()), "labels": pa.list_(pa.string()), "vectors": pa.binary()}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})

    return run


def _tiles(rows: DataFrame, dims: int) -> DataFrame:
    """One row per (family, block)."""
    grouped = rows.select("family", "block", "id", "label", "v").groupBy("family", "block")
    return grouped.applyInArrow(_pack(dims, ["family", "block"]), f"family string, block bigint, {TILE}")


def meet(anchors: DataFrame, tiles: DataFrame) -> DataFrame:
    """Every anchor block with every tile of its family, once, dealt to cells of a grid."""
    left = anchors.groupBy("family").agg(F.count("*").alias("_a"))
    both = left.join(tiles.groupBy("family").agg(F.count("*").alias("_t")), "family")
    pairs = both.agg(F.sum(F.col("_a") * F.col("_t"))).first()[0] or 0
    cores = anchors.sparkSession.sparkContext.defaultParallelism
    each = min(PAIRS_PER_CELL, max(1, pairs // (4 * cores)))
    cells = F.ceil(F.col("_a") * F.col("_t") / each)
    # a grid that repeats as few tiles as it can
    groups = F.greatest(F.lit(1), F.least(F.round(F.sqrt(cells * F.col("_a") / F.col("_t"))), F.col("_a")))
    slices = F.least(F.ceil(cells / groups), F.col("_t"))
    grid = stage(both.select("family", slices.cast("int").alias("_slices"), groups.cast("int").alias("_groups")), "grid")
    total = grid.agg(F.sum(F.col("_slices").cast("long") * F.col("_groups"))).first()[0] or 1
    partitions = max(1, min(total, 100_000))

    def placed(df: DataFrame, prefix: str, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        at = F.pmod(F.xxhash64("family", "block"), F.col(own))
        named = df.join(grid, "family").withColumn(mine, at.cast("int"))
        named = named.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_slices", "_groups")
        renamed = named.select("family", "_s", "_g", *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c != "family"])
        return renamed.repartition(partitions, "family", "_s", "_g")

    a = placed(anchors, "a_", "_groups", "_slices", "_g", "_s")
    c = placed(tiles, "c_", "_slices", "_groups", "_s", "_g")
    return a.hint("merge").join(c, ["family", "_s", "_g"])


class _Side:
    """A tile as arrays."""

    def __init__(self, ids: pa.ListScalar, labels: pa.ListScalar, vectors: pa.BinaryScalar):
        values = ids.values
        self.none = values.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
        self.ids = values.fill_null(0).to_numpy(zero_copy_only=False)
        self.labels = labels.values
        self.matrix = np.frombuffer(vectors.as_buffer(), np.int64).reshape(len(values), -1)


def _same_label(a: _Side, c: _Side) -> np.ndarray:
    codes = pa.concat_arrays([a.labels, c.labels]).dictionary_encode().indices.to_numpy()
    return codes[: len(a.ids), None] == codes[None, len(a.ids) :]


def _itself(a: _Side, c: _Side) -> np.ndarray:
    """Where a candidate has the id and the vector of the anchor."""
    out = np.zeros((len(a.ids), len(c.ids)), bool)
    named = c.ids[: len(c.ids) - int(c.none.sum())]
    starts, ends = np.searchsorted(named, a.ids, "left"), np.searchsorted(named, a.ids, "right")
    for at in np.flatnonzero(ends > starts):
        for there in range(starts[at], ends[at]):
            out[at, there] = np.array_equal(a.matrix[at], c.matrix[there])
    return out


def _positives(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, side, heaps = None, None, None

        def closed() -> Iterator[pa.RecordBatch]:
            found = list(heaps.lists()) if heaps is not None else []
            if found:
                rows = [r for r, _ in found]
                yield pa.RecordBatch.from_arrays([
                    pa.array(side.ids[rows]), side.labels.take(pa.array(rows)),
                    pa.array([side.matrix[r].tobytes() for r in rows], pa.binary()), pa.array([h for _, h in found], HEAP_TYPE),
                ], ["id", "label", "vector", "heap"])

        for batch in batches:
            for at in range(batch.num_rows):
                key = (batch.column("family")[at].as_py(), batch.column("a_block")[at].as_py())
                if key != open_key:
                    yield from closed()
                    side = _Side(*(batch.column(f"a_{c}")[at] for c in ("ids", "labels", "vectors")))
                    open_key, heaps = key, Heaps(len(side.ids), most)
                other = _Side(*(batch.column(f"c_{c}")[at] for c in ("ids", "labels", "vectors")))
                allowed = _same_label(side, other) & ~_itself(side, other)
                heaps.offer(strassen(side.matrix, other.matrix.T), allowed, other.none, other.ids)
        yield from closed()

    return run


def _windowed(lower: int, upper: int, of: int, most: int):
    """Packs anchors and the windows of their positives into one row of a block."""

    def run(table: pa.Table) -> pa.Table:
        heaps = table.column("heap").to_pylist()
        low = np.full((len(heaps), most), 1, np.int64)
        high = np.zeros((len(heaps), most), np.int64)  # an empty window
        for row, heap in enumerate(heaps):
            for slot, entry in enumerate(heap):
                score = ~entry["inverse"]
                low[row, slot], high[row, slot] = max(-(-lower * score // of), LEAST), min(upper * score // of, MOST)
        return pa.table({
            "family": pa.array([""]), "block": pa.array([table.column("block")[0].as_py()], pa.int64()),
            "ids": pa.array([table.column("id").to_pylist()], pa.list_(pa.int64())),
            "labels": pa.array([table.column("label").to_pylist()], pa.list_(pa.string())),
            "vectors": pa.array([b"".join(table.column("vector").to_pylist())], pa.binary()),
            "heaps": pa.array([heaps], pa.list_(HEAP_TYPE)),
            "low": pa.array([low.tobytes()], pa.binary()), "high": pa.array([high.tobytes()], pa.binary()),
        })

    return run


def _negatives(positives: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, side, windows = None, None, None

        def closed() -> Iterator[pa.RecordBatch]:
            if windows is None:
                return
            names = known.as_py()
            for slot, (_, _, heaps) in enumerate(windows):
                found = list(heaps.lists())
                if found:
                    rows = [r for r, _ in found]
                    own = [names[r][slot] for r in rows]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([open_key] * len(rows), pa.int64()), pa.array(rows, pa.int64()), pa.array([slot] * len(rows), pa.int32()),
                        pa.array(side.ids[rows]), pa.array([None if e["none"] else e["id"] for e in own], pa.int64()),
                        pa.array([~e["inverse"] for e in own], pa.int64()), pa.array([h for _, h in found], HEAP_TYPE),
                    ], ["block", "row", "slot", "anchor_id", "positive_id", "positive_score", "heap"])

        for batch in batches:
            for at in range(batch.num_rows):
                key = batch.column("a_block")[at].as_py()
                if key != open_key:
                    yield from closed()
                    side = _Side(*(batch.column(f"a_{c}")[at] for c in ("ids", "labels", "vectors")))
                    known = batch.column("a_heaps")[at]
                    low, high = (
                        np.frombuffer(batch.column(f"a_{c}")[at].as_buffer(), np.int64).reshape(-1, positives) for c in ("low", "high")
                    )
                    windows = [(low[:, s], high[:, s], Heaps(len(side.ids), most)) for s in range(positives)]
                    open_key = key
                other = _Side(*(batch.column(f"c_{c}")[at] for c in ("ids", "labels", "vectors")))
                scores = strassen(side.matrix, other.matrix.T)
                differs = ~_same_label(side, other)
                for low, high, heaps in windows:
                    inside = differs & (scores >= np.maximum(low, heaps.floor)[:, None]) & (scores <= high[:, None])
                    if inside.any():
                        heaps.offer(scores, inside, other.none, other.ids)
        yield from closed()

    return run


def _merged(heaps: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Heaps of one key become one."""
    every = F.sort_array(F.flatten(F.collect_list("heap")))
    return heaps.groupBy(*keys).agg(F.slice(every, 1, most).alias("heap"))


def mine(
    rows: DataFrame,
    anchor: Column,
    label: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    window: tuple[int, int, int] = (50, 95, 100),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` is a condition on the column ``id``, ``label`` an expression over ``rows``. A row is a
    negative of a positive where window[0] * positive_score <= window[2] * score <= window[1] * positive_score.
    """
    items = clean(rows, id_col, vector_col, label, scale)
    is_anchor = F.coalesce(anchor, F.lit(False)) & F.col("id").isNotNull()
    dims = max(items.agg(F.max(F.size("v"))).first()[0] or 0, 1)
    per_tile = max(LEAST_ROWS, CANDIDATE_BYTES // (8 * dims))
    per_block = max(LEAST_ROWS, ANCHOR_BYTES // (8 * dims))

    counts = items.groupBy("label").agg(F.count("*").alias("n"), F.count(F.when(is_anchor, 1)).alias("anchors"))
    counts = stage(counts, "label-counts")
    pooled = counts.filter(F.col("n") <= per_tile).agg(F.sum("n")).first()[0] or 0
    pools = max(1, math.ceil(pooled / per_tile))
    hot = stage(counts.filter(F.col("n") > per_tile).select(
        "label", F.ceil(F.col("n") / per_tile).alias("_tiles"),
        F.greatest(F.ceil(F.col("anchors") / per_block), F.lit(1)).alias("_blocks"),
    ), "hot-labels")
    dealt = F.xxhash64("id", "label", "v")
    family = F.when(F.col("_tiles").isNull(), F.concat(F.lit("~"), F.pmod(F.xxhash64("label"), F.lit(pools)).cast("string")))
    placed = items.join(hot, "label", "left").withColumn("family", F.coalesce(family, F.concat(F.lit("="), "label")))

    def dealt_by(number: str) -> Column:
        return F.pmod(dealt, F.coalesce(F.col(number), F.lit(1))).cast("long")

    tiles = stage(_tiles(placed.withColumn("block", dealt_by("_tiles")), dims), "tiles")
    blocks = stage(_tiles(placed.filter(is_anchor).withColumn("block", dealt_by("_blocks")), dims), "anchor-blocks")

    first = meet(blocks, tiles).mapInArrow(_positives(positives), f"id bigint, label string, vector binary, heap {HEAP}")
    known = stage(_merged(first, ["id", "label", "vector"], positives), "positives")
    number = max(1, math.ceil(known.count() / per_block))
    own = known.withColumn("block", F.pmod(F.xxhash64("id", "label", "vector"), F.lit(number)).cast("long"))
    windows = stage(
        own.groupBy("block").applyInArrow(
            _windowed(*window, positives), f"family string, block bigint, {TILE}, heaps array<{HEAP}>, low binary, high binary"
        ), "windows",
    )
    # one family for all, taken from the column, so that the joins by it stay joins by a key
    every = tiles.withColumn("block", F.xxhash64("family", "block")).withColumn("family", F.substring("family", 1, 0))
    second = meet(windows, every).mapInArrow(
        _negatives(positives, negatives),
        f"block bigint, row bigint, slot int, anchor_id bigint, positive_id bigint, positive_score bigint, heap {HEAP}",
    )
    merged = _merged(second, ["block", "row", "slot", "anchor_id", "positive_id", "positive_score"], negatives)
    told = merged.select("anchor_id", "positive_id", "positive_score", F.posexplode("heap").alias("_at", "_entry"))
    return told.select(
        "anchor_id", "positive_id", (F.col("_at") + 1).cast("int").alias("rank"),
        F.when(F.col("_entry.none") == 0, F.col("_entry.id")).alias("negative_id"), "positive_score",
        F.bitwise_not("_entry.inverse").alias("negative_score"),
    )
