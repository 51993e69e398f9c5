"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def half_even(value: Column, digits: int) -> Column:
    """Round to ``digits`` decimals, ties to even on the scaled value."""
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def bin_index(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin of ``value`` in [low, high]; the last bin is closed."""
    width = (high - low) / F.lit(float(bins))
    position = F.floor((value - low) / width).cast("int")
    return F.when(high <= low, F.lit(0)).otherwise(F.least(position, F.lit(bins - 1)))


def unit_scale(value: Column, low: Column, high: Column, epsilon: float = 1e-9) -> Column:
    """Map [low, high] to [-1, 1]; a constant column maps to -1."""
    return F.lit(2.0) * (value - low) / (high - low + F.lit(epsilon)) - F.lit(1.0)


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound ``value``; a null stays null."""
    out = value
    if low is not None:
        out = F.when(out < F.lit(low), F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > F.lit(high), F.lit(high)).otherwise(out)
    return out


def shifted(value: Column, log: bool = False) -> Column:
    """``value + 1``, or its natural logarithm."""
    return F.log1p(value) if log else value + F.lit(1)


def whole_days(moment: Column, as_of: Column) -> Column:
    """Complete 24-hour periods from ``moment`` to ``as_of``."""
    micros = F.timestamp_diff("MICROSECOND", moment, as_of)
    return F.floor(micros / F.lit(86_400_000_000)).cast("int")


def dominance(largest: Column, total: Column, blockbuster: float = 0.6, contested: float = 0.35) -> Column:
    """Market shape of a group from the share its largest member holds."""
    share = largest / total
    return (
        F.when(F.coalesce(total, F.lit(0)) <= 0, F.lit("long-tail"))
        .when(share > blockbuster, F.lit("blockbuster"))
        .when(share > contested, F.lit("contested"))
        .otherwise(F.lit("long-tail"))
    )
