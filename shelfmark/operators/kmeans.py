"""KMeans with many restarts that share every pass over the points.

Seeding takes a few passes: in each, every restart draws the next candidates at random, in proportion to
their squared distance from those it has. A draw is the smallest of a random number divided by that
distance, so that the draws of tasks merge by taking the smallest again. The candidates, weighted by the
points nearest to them, are then thinned out to k on the driver. Lloyd's steps carry the centres of all
restarts that still move through one pass; a restart stops when its centres move less than the tolerance.
The cheapest restart is the result.

Random numbers are hashes of the point, the restart and the round: a task that is run again draws the
same. Beyond the points a task holds a few numbers for each centre, and the driver the centres:
restarts x k x dimensions, checked against ``CENTRE_BYTES``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from shelfmark.operators.partial import summed
from shelfmark.session import stage, unstage

CENTRE_BYTES = 64 << 20
ROUNDS = 5


@dataclass(frozen=True)
class Clustering:
    """Centres (k x dimensions), the sum of squared distances to them, and the costs of all restarts."""

    centres: np.ndarray
    cost: float
    iterations: int
    costs: tuple[float, ...]


def _tools():
    """What tasks compute with: local functions travel by value, so executors need no copy of this package."""

    def matrices(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                yield part.column(1).to_numpy(zero_copy_only=False), part.column(0).flatten().to_numpy().reshape(part.num_rows, -1)

    def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        """Squared distances; small ones are taken from the differences, as the short form loses them."""
        square = (x * x).sum(1)[:, None]
        out = x @ (-2 * centres.T)
        out += square
        out += (centres * centres).sum(1)
        close = np.flatnonzero(out.min(1) < 1e-9 * (1 + square[:, 0])) if out.size else ()
        if len(close):
            row, at = np.nonzero(out[close] < 1e-9 * (1 + square[close]))
            row = close[row]
            out[row, at] = ((x[row] - centres[at]) ** 2).sum(1)
        return out

    def uniform(hashes: np.ndarray, salt: int) -> np.ndarray:
        """A number in (0, 1) for each 64-bit hash."""
        x = hashes.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 & (2**64 - 1))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53 + 2.0**-54

    return matrices, distances, uniform


def _draw(points: DataFrame, sets: list[np.ndarray] | None, restarts: int, number: int, salt: int) -> list[np.ndarray]:
    """For each restart the next ``number`` candidates, far from those in ``sets`` with high probability."""
    matrices, distances, uniform = _tools()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[tuple[float, bytes]]] = [[] for _ in range(restarts)]
        for hashes, x in matrices(batches):
            for r in range(restarts):
                far = np.ones(len(x)) if sets is None else distances(x, sets[r]).min(1)
                with np.errstate(divide="ignore"):
                    keys = np.where(far > 0, -np.log(uniform(hashes, salt + r)) / np.maximum(far, 1e-300), np.inf)
                first = np.argsort(keys, kind="stable")[: 2 * number]
                new = {(float(keys[i]), x[i].tobytes()) for i in first if np.isfinite(keys[i])}
                kept[r] = sorted({*kept[r], *new})[:number]
        for r, drawn in enumerate(kept):
            if drawn:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r] * len(drawn), pa.int32()), pa.array([k for k, _ in drawn]), pa.array([v for _, v in drawn], pa.binary())],
                    ["restart", "key", "point"],
                )

    drawn = points.mapInArrow(run, "restart int, key double, point binary").distinct()
    order = Window.partitionBy("restart").orderBy("key", "point")
    best = drawn.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= number)
    out: list[list] = [[] for _ in range(restarts)]
    for row in best.orderBy("restart", "key", "point").collect():
        out[row["restart"]].append(np.frombuffer(row["point"], np.float64))
    return [np.array(x) for x in out]


def _weights(points: DataFrame, sets: list[np.ndarray]) -> list[np.ndarray]:
    """Points nearest to each candidate of each restart."""
    most = max(len(s) for s in sets)
    matrices, distances, _ = _tools()

    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((len(sets), most))
        for _, x in matrices(batches):
            for r, own in enumerate(sets):
                total[r] += np.bincount(distances(x, own).argmin(1), minlength=most)
        return total

    counts = summed(points, part, (len(sets), most))
    return [counts[r, : len(own)] for r, own in enumerate(sets)]


def _thinned(candidates: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of the candidates, far from each other, then a few steps among the candidates."""
    chosen = [int(rng.choice(len(candidates), p=weights / weights.sum()))]
    near = ((candidates - candidates[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(k, len(candidates)):
        chance = near * weights
        if chance.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(candidates), p=chance / chance.sum())))
        near = np.minimum(near, ((candidates - candidates[chosen[-1]]) ** 2).sum(1))
    centres = candidates[chosen].copy()
    for _ in range(30):
        label = ((candidates[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        moved = np.array([
            np.average(candidates[label == c], axis=0, weights=weights[label == c]) if weights[label == c].sum() > 0 else centres[c]
            for c in range(len(centres))
        ])
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres


def _step(points: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums, counts, cost) by restart of one pass, for centres (restarts x k x dimensions)."""
    restarts, k, dims = centres.shape
    matrices, distances, _ = _tools()

    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((restarts * k, dims + 2))
        for _, x in matrices(batches, 512):  # a table that stays in the cache
            far = distances(x, centres.reshape(-1, dims)).reshape(len(x), restarts, k)
            label = far.argmin(2) + np.arange(0, restarts * k, k)
            least = np.maximum(far.min(2), 0.0)
            # every distance has been used: the table becomes that of the points held by each centre
            held = far.reshape(len(x), -1)
            held[:] = 0.0
            held[np.arange(len(x))[:, None], label] = 1.0
            total[:, :dims] += held.T @ x
            total[:, dims] += np.bincount(label.ravel(), minlength=restarts * k)
            total[:, dims + 1] += np.bincount(label.ravel(), least.ravel(), restarts * k)
        return total

    total = summed(points, part, (restarts * k, dims + 2)).reshape(restarts, k, dims + 2)
    return total[:, :, :dims], total[:, :, dims], total[:, :, dims + 1].sum(1)


def fit(
    vectors: DataFrame, column: str, k: int, restarts: int = 10, max_iter: int = 300, seed: int = 42, tolerance: float = 1e-4
) -> Clustering:
    """The cheapest of ``restarts`` runs; rows without a vector are left out.

    A run ends when the squared distances that its centres move are together at most ``tolerance`` times
    the mean variance of an axis. With fewer than k different points there are as many centres as points.
    """
    array = F.col(column).cast("array<double>").alias("x")
    points = stage(vectors.filter(F.col(column).isNotNull()).select(array).select("x", F.xxhash64("x").alias("h")), "points")
    sizes = points.agg(F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high"), F.count("*").alias("n")).first()
    if sizes["n"] == 0:
        raise ValueError("there are no points")
    if sizes["low"] != sizes["high"]:
        raise ValueError("the vectors differ in length")
    dims = sizes["high"]
    if 8 * restarts * k * (2 * ROUNDS + 1) * dims > CENTRE_BYTES:
        raise ValueError(f"the candidates of all restarts must fit in {CENTRE_BYTES} bytes; take fewer restarts")
    matrices, _, _ = _tools()

    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((2, dims))
        for _, x in matrices(batches):
            total += [x.sum(0), (x * x).sum(0)]
        return total

    sums = summed(points, part, (2, dims))
    variance = float(np.maximum(sums[1] / sizes["n"] - (sums[0] / sizes["n"]) ** 2, 0.0).mean())

    sets = _draw(points, None, restarts, 1, seed * 1_000_003)
    for turn in range(1, ROUNDS + 1):
        new = _draw(points, sets, restarts, 2 * k, seed * 1_000_003 + turn * 10_007)
        sets = [np.concatenate([a, b]) if len(b) else a for a, b in zip(sets, new)]
    weights = _weights(points, sets)
    rng = np.random.default_rng(seed)
    starts = [_thinned(c, w, k, rng) for c, w in zip(sets, weights)]
    found = max(len(s) for s in starts)  # fewer than k only when there are no more different points
    centres = np.stack([np.concatenate([s, np.repeat(s[:1], found - len(s), axis=0)]) for s in starts])

    moving, steps = np.arange(restarts), np.zeros(restarts, int)
    while len(moving) and steps.max() < max_iter:
        sums, counts, _ = _step(points, centres[moving])
        filled = counts > 0
        moved = np.where(filled[:, :, None], sums / np.maximum(counts, 1)[:, :, None], centres[moving])
        shift = ((moved - centres[moving]) ** 2).sum((1, 2))
        centres[moving] = moved
        steps[moving] += 1
        moving = moving[shift > tolerance * variance]
    _, _, costs = _step(points, centres)
    unstage(points)
    best = min(range(restarts), key=lambda r: (float(f"{costs[r]:.9e}"), r))
    return Clustering(centres[best], float(costs[best]), int(steps[best]), tuple(costs.tolist()))


def assign(model: Clustering, vectors: DataFrame, column: str, label: str = "cluster") -> DataFrame:
    """Every row with the number of its nearest centre, the smaller one of equals; null without a vector."""
    centres = model.centres
    _, distances, _ = _tools()

    def nearest(x: pa.Array) -> pa.Array:
        held = x.is_valid().to_numpy(zero_copy_only=False)
        rows = x.drop_null().flatten().to_numpy().reshape(int(held.sum()), -1)
        out = np.zeros(len(x), np.int32)
        for at in range(0, len(rows), 4096):
            out[np.flatnonzero(held)[at : at + 4096]] = distances(rows[at : at + 4096], centres).argmin(1)
        return pa.array(out, pa.int32(), mask=~held)

    return vectors.withColumn(label, F.arrow_udf(nearest, "int")(F.col(column).cast("array<double>")))
