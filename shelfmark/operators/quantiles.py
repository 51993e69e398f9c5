"""Exact quantiles of a column in two scans, however many are wanted.

The first scan makes a mergeable sketch: values wait in levels, a full level is sorted, and every other
value moves up one level, where it stands for twice as many. Each such step can move a rank by at most
what one value of its level stands for; these errors are added up, so that the sketch gives, for any rank, a
lower and an upper value with a guarantee. The second scan counts what lies below each of these brackets
and keeps the values inside, counted by task. They are a small part of the table; sorted by ranges, with sums
for each range, they hold the wanted ranks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from shelfmark.session import stage, unstage

LEVEL = 1 << 14  # values that a level holds
REDUCERS = 16


def _sketch_of(level: int):
    """Local functions, so that they travel by value. A sketch is ([values by level], error)."""

    def add(levels: list[np.ndarray], height: int, values: np.ndarray) -> int:
        """The levels with more values of one height; what the steps may have moved a rank by."""
        error = 0
        while len(levels) <= height:
            levels.append(np.empty(0))
        levels[height] = np.concatenate([levels[height], values])
        while height < len(levels) and len(levels[height]) > level:
            held = np.sort(levels[height])
            odd = len(held) % 2
            levels[height] = held[:odd]
            if height + 1 == len(levels):
                levels.append(np.empty(0))
            # one or the other half, by turns that depend on the data alone
            moved = held[odd:][len(levels[height + 1]) % 2 :: 2]
            levels[height + 1] = np.concatenate([levels[height + 1], moved])
            error += 1 << height
            height += 1
        return error

    def told(levels: list[np.ndarray], error: int) -> pa.RecordBatch:
        rows = [(h, v.tobytes()) for h, v in enumerate(levels) if len(v)] + [(-1, np.array([float(error)]).tobytes())]
        return pa.RecordBatch.from_arrays(
            [pa.array([h for h, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.binary())], ["height", "held"]
        )

    def made(batches):
        levels, error = [], 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            error += add(levels, 0, values)
        yield told(levels, error)

    def merged(batches):
        levels, error = [], 0
        for batch in batches:
            for height, held in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = np.frombuffer(held.as_buffer(), np.float64)
                error += int(values[0]) if height < 0 else add(levels, height, values)
        yield told(levels, error)

    return made, merged


def sketch(values: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(values ascending, what each stands for, the most a rank may be off) of one column without nulls."""
    made, merged = _sketch_of(LEVEL)
    shape = "height int, held binary"
    parts = values.mapInArrow(made, shape).withColumn("part", F.spark_partition_id() % REDUCERS)
    rows = parts.repartition(REDUCERS, "part").select("height", "held").mapInArrow(merged, shape).collect()
    held = [(np.frombuffer(r["held"], np.float64), 1 << r["height"]) for r in rows if r["height"] >= 0]
    error = sum(int(np.frombuffer(r["held"], np.float64)[0]) for r in rows if r["height"] < 0)
    if not held:
        return np.empty(0), np.empty(0, np.int64), 0
    every = np.concatenate([v for v, _ in held])
    stands = np.concatenate([np.full(len(v), w, np.int64) for v, w in held])
    order = np.argsort(every, kind="stable")
    return every[order], stands[order], error


def _bracket(every: np.ndarray, upto: np.ndarray, error: int, rank: int) -> tuple[float, float]:
    """Values that the one at ``rank`` cannot lie outside of."""
    low = int(np.searchsorted(upto, rank - error, "right"))
    high = int(np.searchsorted(upto, rank + error, "right"))
    before = float(every[low - 1]) if low else -math.inf
    return (before if error else float(every[low])), float(every[high]) if high < len(every) else math.inf


def at_ranks(values: DataFrame, ranks: Sequence[int], known: tuple) -> dict[int, float]:
    """The values (v, doubles without NaN) at the ranks, counted from 0."""
    every, stands, error = known
    upto = np.cumsum(stands)
    brackets = {rank: _bracket(every, upto, error, rank) for rank in sorted(set(ranks))}
    found = {rank: low for rank, (low, high) in brackets.items() if low == high and not error}
    open_ones = sorted({b for rank, b in brackets.items() if rank not in found})
    if not open_ones:
        return found

    def inside(batches):
        """(bracket, v, n): values inside with their number, and, without a value, the number below."""
        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False)
            for at, (low, high) in enumerate(open_ones):
                own, n = np.unique(v[(v >= low) & (v <= high)], return_counts=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array([at] * (len(own) + 1), pa.int32()), pa.array([None, *own.tolist()], pa.float64()),
                    pa.array([int((v < low).sum()), *n.tolist()], pa.int64()),
                ], ["bracket", "v", "n"])

    parts = values.mapInArrow(inside, "bracket int, v double, n bigint")
    kept = stage(parts.groupBy("bracket", "v").agg(F.sum("n").alias("n")), "brackets")
    below = {r["bracket"]: r["n"] for r in kept.filter(F.col("v").isNull()).collect()}
    lined = kept.filter(F.col("v").isNotNull()).repartitionByRange("bracket", "v").sortWithinPartitions("bracket", "v")
    lined = stage(lined.withColumn("part", F.spark_partition_id()), "lined")
    sizes = lined.groupBy("bracket", "part").agg(F.sum("n").alias("n")).orderBy("bracket", "part").collect()
    wanted = []  # (rank, bracket, part, rank inside the part)
    for rank, bracket in brackets.items():
        if rank in found:
            continue
        at = open_ones.index(bracket)
        left = rank - below[at]
        for row in (r for r in sizes if r["bracket"] == at):
            if 0 <= left < row["n"]:
                wanted.append((rank, at, row["part"], left))
            left -= row["n"]
    places = values.sparkSession.createDataFrame(wanted, "rank bigint, bracket int, part int, place bigint")
    order = Window.partitionBy("rank").orderBy("v")  # one range of the sorted values
    counted = lined.join(F.broadcast(places), ["bracket", "part"]).withColumn("upto", F.sum("n").over(order))
    hit = counted.filter((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("n") <= F.col("place")))
    found |= {r["rank"]: r["v"] for r in hit.collect()}
    unstage(kept, lined)
    return found


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation between the two nearest ranks, in the order of ``shares``.

    Nulls and NaN are left out; infinite values stand at the ends. Null where there are no values.
    """
    given = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    known = sketch(given)
    count = int(known[1].sum())
    if not count:
        return [None] * len(shares)
    positions = [q * (count - 1) for q in shares]
    ranks = {min(math.floor(p) + up, count - 1) for p in positions for up in (0, 1)}
    at = at_ranks(given, sorted(ranks), known)

    def between(position: float) -> float:
        rank = math.floor(position)
        lower, upper, share = at[rank], at[min(rank + 1, count - 1)], position - rank
        if share == 0 or lower == upper:
            return lower
        if math.isinf(upper - lower) and math.isfinite(lower) and math.isfinite(upper):
            return lower * (1 - share) + upper * share
        return lower + (upper - lower) * share

    return [between(p) for p in positions]
