"""Positional buckets of a stream of daily counts, and a store that a stream refreshes.

``positional`` keeps, for each key, the place of its last day and the bucket that is still open; a day
that arrives later than a later one of its key has no place any more and comes out without a bucket.
``refresh`` stores rows by batch, so that a batch that is run again replaces itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelfmark.operators.metadata import last_wins

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shape(key: str, kind: T.DataType) -> T.StructType:
    """What is stored of a bucket."""
    return T.StructType([
        T.StructField(key, kind), T.StructField("bucket", T.IntegerType()), T.StructField("week_end", T.DateType()),
        T.StructField("downloads", T.DoubleType()), T.StructField("days", T.IntegerType()),
    ])


def positional(
    daily: DataFrame, key: str, day: str = "day", value: str = "downloads", size: int = 7
) -> DataFrame:
    """(key, bucket, week_end, downloads, days) of every bucket that a batch has changed.

    ``daily`` is a stream with one row per key and day. Batches may hold many days of a key, in any
    order; between batches days of a key come in order. Gaps count nowhere: a bucket is ``size`` rows.
    The last state of a bucket is the one with the most days, see :func:`latest`.
    """
    of_key = daily.schema[key]

    class Places(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.open = handle.getValueState("open", "place bigint, last date, downloads double")

        def handleInputRows(self, own, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
            place, last, total = self.open.get() if self.open.exists() else (0, None, 0.0)
            given = pd.concat(list(rows)).sort_values("day")
            changed: dict[int, tuple] = {}
            late = []
            for at, count in zip(given["day"], given["downloads"]):
                if last is not None and at <= last:
                    late.append((own[0], None, at, count, 1))
                    continue
                total = count if place % size == 0 else total + count
                changed[place // size] = (own[0], place // size, at, total, place % size + 1)
                place, last = place + 1, at
            self.open.update((place, last, total))
            yield pd.DataFrame([*changed.values(), *late], columns=["key", "bucket", "week_end", "downloads", "days"]).astype(
                {"bucket": "Int32", "days": "int32"}
            )

        def close(self) -> None:
            pass

    plain = daily.select(F.col(key).alias("key"), F.col(day).cast("date").alias("day"), F.col(value).cast("double").alias("downloads"))
    told = plain.groupBy("key").transformWithStateInPandas(Places(), shape("key", of_key.dataType), "Update", "None")
    return told.withColumnRenamed("key", key)


def latest(stored: DataFrame, key: str, drop_partial: bool = False, size: int = 7) -> DataFrame:
    """(key, bucket, week_end, downloads): the last state of each bucket, out of all that were stored."""
    placed = stored.filter(F.col("bucket").isNotNull())
    state = F.max_by(F.struct("week_end", "downloads", "days"), "days").alias("last")
    last = placed.groupBy(key, "bucket").agg(state)
    kept = last.filter(F.col("last.days") == size) if drop_partial else last
    return kept.select(key, "bucket", "last.week_end", "last.downloads")


def store_positional(
    daily: DataFrame, path: str, checkpoint: str, key: str, day: str = "day", value: str = "downloads", size: int = 7
) -> None:
    """Process the days landed so far, write the buckets that they change under ``path``, and stop.

    Every batch has a folder of its own, so that one that is run again replaces what it wrote. A later
    call with the same folders goes on with the places and open buckets of this one.
    """
    spark = daily.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        _run(positional(daily, key, day, value, size), checkpoint, lambda rows, number: _write(rows, path, number), "update")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def _run(stream: DataFrame, checkpoint: str, take, mode: str) -> None:
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    query.start().awaitTermination()


def _write(rows: DataFrame, path: str, number: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={number}")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows under ``path`` with the number of their batch; none if nothing was written yet."""
    whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    if not _exists(spark, path):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).parquet(path)


def refresh_available(
    stream: DataFrame, path: str, checkpoint: str, key: str, order: Sequence[str], max_age: str = "7 days"
) -> None:
    """Store what landed, by key: keys that are new, and keys whose stored row is ``max_age`` older or more.

    ``order`` begins with the moment of a row; of rows of one key in a batch the last one counts.

    The batch's number is the ledger: a batch looks at the rows of earlier numbers only, and writes a
    folder of its own. Run again, after a failure at any point, it finds and writes the same.
    """
    spark, schema = stream.sparkSession, stream.schema

    def take(batch: DataFrame, number: int) -> None:
        newest, moment = last_wins(batch, key, order), order[0]
        earlier = stored(spark, path, schema).filter(F.col("batch") < number)
        known = earlier.groupBy(key).agg(F.max(moment).alias("_had"))
        due = F.col("_had").isNull() | (F.col(moment) >= F.col("_had") + F.expr(f"INTERVAL {max_age}"))
        _write(newest.join(known, key, "left").filter(due).select(*schema.names), path, number)

    _run(stream, checkpoint, take, "append")


def current(spark: SparkSession, path: str, schema: T.StructType, key: str, order: Sequence[str]) -> DataFrame:
    """The row of each key that counts: the one stored last."""
    return last_wins(stored(spark, path, schema), key, ["batch", *order]).select(*schema.names)


def ledger(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(batch, rows) of the batches that are stored."""
    return stored(spark, path, schema).groupBy("batch").agg(F.count("*").alias("rows"))
