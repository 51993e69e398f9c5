"""Joins whose left side may hold a few very hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from shelfmark.session import stage


def hot_keys(df: DataFrame, keys: Sequence[str], rows_per_task: int) -> DataFrame:
    """Every key with more than ``rows_per_task`` rows and the number of slices it is cut into.

    There are at most the rows divided by ``rows_per_task``. The list is written once, so that
    the optimizer knows its size: it is broadcast while that is small, and joined by shuffle, with
    skewed partitions split at run time, when it is not.
    """
    counted = df.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > rows_per_task)
    slices = F.ceil(F.col("_rows") / rows_per_task).cast("int")
    return stage(counted.select(*keys, slices.alias("_slices")), "hot-keys")


def _with_slices(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach the slice count, matching null keys too."""
    renamed = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], "_slices")
    match = [df[k].eqNullSafe(renamed[f"_hot_{k}"]) for k in keys]
    joined = df.join(renamed, match, "left")
    return joined.drop(*[f"_hot_{k}" for k in keys])


def spread_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    rows_per_task: int = 200_000,
    condition=None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Equi-join on ``keys`` that cuts every hot left key into slices.

    Left rows of a hot key are dealt to slices by a hash of ``spread_by``; right rows of that
    key are repeated once per slice. Every left row meets every right row of its key exactly
    once, so the result equals the plain join. ``how`` is inner, left, left_semi or left_anti. Who knows
    the hot keys already gives them as ``hot`` (keys, _slices).
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    if condition is not None and how != "inner":
        raise ValueError("a condition is for inner joins")
    hot = hot_keys(left, keys, rows_per_task) if hot is None else hot
    slices = F.coalesce(F.col("_slices"), F.lit(1))
    dealt = _with_slices(left, hot, keys).withColumn(
        "_slice", F.pmod(F.xxhash64(*spread_by), slices).cast("int")
    ).drop("_slices")
    repeated = _with_slices(right, hot, keys).withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), slices - 1))
    ).drop("_slices")
    on = [*keys, "_slice"]
    if condition is None:
        return dealt.join(repeated, on, how).drop("_slice")
    return dealt.join(repeated, on, how).filter(condition).drop("_slice")


def dense_numbers(df: DataFrame, order: Sequence[str], column: str) -> DataFrame:
    """Every row with its place 0, 1, ... by ``order``, which is unique, in ``column``.

    Rows are sorted by ranges and numbered in their range; the ranges' sizes, one number for each
    partition, tell where each begins. No task sees all rows.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(placed.withColumn("_id", F.monotonically_increasing_id()), "ranges")
    part, within = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).collect()
    starts, so_far = [], 0
    for row in sorted(sizes):
        starts.append((row["_part"], so_far))
        so_far += row["_n"]
    offsets = df.sparkSession.createDataFrame(starts, "_part bigint, _start bigint")
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.withColumn(column, F.col("_start") + within).drop("_part", "_start", "_id")


def block_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_by: str,
    right_by: str,
    condition,
    rows_per_block: int = 20_000,
) -> DataFrame:
    """Equi-join on ``key`` for sides that both repeat it.

    A hot key becomes a grid of left slices by right slices, so that one task never meets more
    than about ``rows_per_block`` rows of either side. Every pair meets in exactly one cell.
    """
    def numbered(df: DataFrame, name: str) -> DataFrame:
        return hot_keys(df, [key], rows_per_block).withColumnRenamed("_slices", name)

    grid = numbered(left, "_l").join(numbered(right, "_r"), key, "full_outer")
    grid = grid.select(key, F.coalesce("_l", F.lit(1)).alias("_l"), F.coalesce("_r", F.lit(1)).alias("_r"))
    grid = stage(grid, "grid")
    one = F.lit(1)
    rows, columns = F.coalesce("_l", one), F.coalesce("_r", one)

    def cells(df: DataFrame, by: str, mine, other, my_name: str, other_name: str) -> DataFrame:
        placed = df.join(grid, key, "left")
        return (
            placed.withColumn(my_name, F.pmod(F.xxhash64(by), mine).cast("int"))
            .withColumn(other_name, F.explode(F.sequence(F.lit(0), other - 1)))
            .drop("_l", "_r")
        )

    a = cells(left, left_by, rows, columns, "_row", "_column")
    b = cells(right, right_by, columns, rows, "_column", "_row")
    return a.join(b, [key, "_row", "_column"]).filter(condition).drop("_row", "_column")
