"""Incremental pick-up of landed files and weekly totals over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import TimestampNTZType


def landed(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", format: str = "parquet") -> DataFrame:
    """A stream of the files that land in ``folder``."""
    return spark.readStream.format(format).schema(schema).option("pathGlobFilter", pattern).load(folder)


def weekly_windows(
    stream: DataFrame, moment: str, by: str, value: str, start: str = "0 days", delay: str = "1 day"
) -> DataFrame:
    """Totals per seven-day window and group; a window is emitted once the watermark passes it.

    A moment without a time zone is taken as UTC, and windows start on UTC days, whatever the
    session's time zone is.
    """
    at = F.col(moment).cast("timestamp")
    if isinstance(stream.schema[moment].dataType, TimestampNTZType):
        at = F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{moment}`)"))
    timed = stream.withColumn("_at", at).withWatermark("_at", delay)
    window = F.window("_at", "7 days", startTime=start)
    day = F.date_from_unix_date(F.floor(F.unix_seconds("w.start") / 86400).cast("int"))
    return (
        timed.groupBy(window.alias("w"), by)
        .agg(F.sum(value).alias("total"), F.count("*").alias("n"))
        .select(day.alias("week_start"), by, "total", "n")
    )


def store_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything landed so far, append it to ``path`` and stop.

    The checkpoint remembers processed files: a later run with the same folders adds only what
    landed in between, exactly once.
    """
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def unseen(stream: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Landed rows whose key is not stored yet."""
    return stream.join(stored.select(key), key, "left_anti")
