"""Buckets and stores that a stream keeps up to date, and bucketed tables."""

import datetime
import random
import uuid

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import metadata, trends
from shelfmark.sources import readers, writers
from shelfmark.streaming import buckets, landing

DAY = datetime.date(2025, 1, 1)
DAILY = "name string, day date, downloads double"


def run(spark, folder, rows, part):
    frame = spark.createDataFrame(rows, DAILY)
    frame.coalesce(1).write.mode("append").parquet(f"{folder}/days")
    stream = landing.landed(spark, f"{folder}/days", frame.schema)
    buckets.store_positional(stream, f"{folder}/out", f"{folder}/state", "name")
    return buckets.stored(spark, f"{folder}/out", buckets.shape("name", frame.schema["name"].dataType))


def series(seed, days):
    """Days with gaps, different for each key."""
    r = random.Random(seed)
    return [(k, DAY + datetime.timedelta(days=d), float(r.randint(0, 9))) for k in ("a", "b", None) for d in range(days) if r.random() < 0.7]


@pytest.mark.parametrize("cuts", [[20], [3, 4, 33]])
def test_parts_give_the_buckets_of_the_whole(spark, tmp_path, cuts):
    rows = series(len(cuts), 50)
    edges = [DAY, *[DAY + datetime.timedelta(days=c) for c in cuts], DAY + datetime.timedelta(days=99)]
    for part, (low, high) in enumerate(zip(edges, edges[1:])):
        found = run(spark, str(tmp_path), [r for r in rows if low <= r[1] < high], part)
    whole = trends.positional_buckets(spark.createDataFrame(rows, DAILY), "name")
    key = lambda r: str(r)
    latest = buckets.latest(found, "name").select(*whole.columns).collect()
    assert sorted(map(tuple, latest), key=key) == sorted(map(tuple, whole.collect()), key=key)
    full = trends.positional_buckets(spark.createDataFrame(rows, DAILY), "name", drop_partial=True)
    assert buckets.latest(found, "name", drop_partial=True).count() == full.count()


def test_a_day_that_comes_too_late_has_no_bucket(spark, tmp_path):
    first = [("a", DAY + datetime.timedelta(days=d), 1.0) for d in (0, 1, 5)]
    run(spark, str(tmp_path), first, 0)
    found = run(spark, str(tmp_path), [("a", DAY + datetime.timedelta(days=3), 7.0), ("a", DAY + datetime.timedelta(days=6), 2.0)], 1)
    late = found.filter("bucket is null").collect()
    assert [(r.week_end, r.downloads) for r in late] == [(DAY + datetime.timedelta(days=3), 7.0)]
    assert [tuple(r) for r in buckets.latest(found, "name").collect()] == [("a", 0, DAY + datetime.timedelta(days=6), 5.0)]


def test_nothing_new_changes_nothing(spark, tmp_path):
    found = run(spark, str(tmp_path), series(7, 20), 0)
    before = sorted(map(str, found.collect()))
    stream = landing.landed(spark, f"{tmp_path}/days", spark.read.parquet(f"{tmp_path}/days").schema)
    buckets.store_positional(stream, f"{tmp_path}/out", f"{tmp_path}/state", "name")
    assert sorted(map(str, found.collect())) == before


# A store that is refreshed

STORE = "name string, at timestamp_ntz, v int"


def land(spark, folder, rows):
    frame = spark.createDataFrame(rows, STORE)
    frame.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return landing.landed(spark, f"{folder}/in", frame.schema), frame.schema


def at(day, hour=0):
    return datetime.datetime(2025, 1, day, hour)


def refreshed(spark, folder, rows, checkpoint="state"):
    stream, schema = land(spark, folder, rows) if rows else (landing.landed(spark, f"{folder}/in", STORE), None)
    buckets.refresh_available(stream, f"{folder}/store", f"{folder}/{checkpoint}", "name", ["at", "v"])
    return {r["name"]: r["v"] for r in buckets.current(spark, f"{folder}/store", stream.schema, "name", ["at", "v"]).collect()}


def test_old_rows_are_replaced_and_fresh_ones_are_not(spark, tmp_path):
    folder = str(tmp_path)
    assert refreshed(spark, folder, [("a", at(1), 1), ("a", at(2), 2), ("b", at(1), 3)]) == {"a": 2, "b": 3}
    assert refreshed(spark, folder, [("a", at(8), 4), ("b", at(8), 5), ("c", at(1), 6)]) == {"a": 2, "b": 5, "c": 6}
    assert refreshed(spark, folder, [("a", at(9), 7)]) == {"a": 7, "b": 5, "c": 6}


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    """Without its checkpoint the stream is read from its start, batch by batch of the same numbers."""
    folder = str(tmp_path)
    once = refreshed(spark, folder, [("a", at(1), 1), ("b", at(1), 2)])
    schema = landing.landed(spark, f"{folder}/in", STORE).schema
    rows = sorted(map(str, buckets.stored(spark, f"{folder}/store", schema).collect()))
    assert refreshed(spark, folder, [], "state-again") == once
    assert sorted(map(str, buckets.stored(spark, f"{folder}/store", schema).collect())) == rows
    assert [tuple(r) for r in buckets.ledger(spark, f"{folder}/store", schema).collect()] == [(0, 2)]


def test_an_unwritten_store_is_empty(spark, tmp_path):
    schema = spark.createDataFrame([], STORE).schema
    assert buckets.stored(spark, str(tmp_path / "none"), schema).count() == 0


# Tables in buckets


def test_a_bucketed_cache_is_not_shuffled(spark, tmp_path):
    name, path = f"cache_{uuid.uuid4().hex}", str(tmp_path / "vectors")
    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    writers.append_bucketed(rows.filter("k < 600"), name, path, "k", 4)
    writers.append_bucketed(metadata.missing_keys(rows, spark.table(name), "k"), name, path, "k", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for joined in (metadata.align(rows, spark.table(name), "k"), metadata.missing_keys(rows, spark.table(name), "k")):
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        assert sorted(map(tuple, metadata.align(rows, spark.table(name), "k").collect())) == [(i, 2 * i) for i in range(1000)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql(f"DROP TABLE {name}")


# Side files and datasets


def test_side_files_are_keyed_by_their_names(spark, tmp_path):
    path = str(tmp_path / "repos")
    files = spark.createDataFrame([("o__r", '{"stargazers_count": 3, "pushed_at": "never"}'), ("o__s", "{")], "slug string, body string")
    writers.write_named(files, path, "slug", "body")
    found = readers.read_repositories(spark, path)
    columns = {r.slug: (r.stars, r.pushed_at) for r in metadata.repository_columns(found).collect()}
    assert columns == {"o__r": (3, None), "o__s": (None, None)}
    wanted = spark.createDataFrame([("p", "o__r"), ("q", "o__none"), ("z", None)], "name string, slug string")
    joined = metadata.attach(wanted, metadata.repository_columns(found), "slug", "name")
    assert {r["name"]: r.stars for r in joined.collect()} == {"p": 3, "q": None, "z": None}


def test_datasets_are_written_in_one_step(spark, tmp_path):
    frame = spark.createDataFrame([(1, ["a"]), (2, [])], "k int, v array<string>")
    paths = writers.publish({"one": ("json", frame), "two": ("json.gz", frame), "three": ("parquet", frame)}, str(tmp_path))
    for name, read in (("one", "json"), ("two", "json"), ("three", "parquet")):
        back = spark.read.schema(frame.schema).format(read).load(paths[name])
        assert sorted(map(str, back.collect())) == sorted(map(str, frame.collect()))
    assert list((tmp_path / "two").glob("*.json.gz"))
    with pytest.raises(ValueError):
        writers.publish({"x": ("csv", frame)}, str(tmp_path))
