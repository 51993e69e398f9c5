"""Distributions, ingest and incremental loads."""

import json
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from shelfmark.operators import metadata, quantiles, stats
from shelfmark.session import fresh_path, stage
from shelfmark.sources import readers, schemas, writers
from shelfmark.streaming import landing

finite = st.floats(-1e6, 1e6, allow_nan=False)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(finite, min_size=1, max_size=60), q=st.sampled_from([0.0, 0.5, 0.95, 1.0]))
def test_quantile(spark, values, q):
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    assert stats.exact_quantile(frame, "v", q) == pytest.approx(np.quantile(values, q), rel=1e-9, abs=1e-9)


def test_quantile_of_repeated_and_skewed_values(spark):
    values = [5.0] * 300 + [float(2**i) for i in range(60)] + [1e-9 * i for i in range(50)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for q in (0.05, 0.1, 0.3, 0.85, 0.95, 0.99):
        assert stats.exact_quantile(frame, "v", q) == pytest.approx(np.quantile(values, q), rel=1e-9)
    assert stats.exact_quantile(frame.filter(F.lit(False)), "v", 0.5) is None


def test_histogram_equals_numpy(spark):
    values = [0.0, 1.0, 1.0, 2.5, 9.9, 10.0, None]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    found = [r.n for r in stats.histogram(frame, F.col("v"), 4).orderBy("bin").collect()]
    assert found == np.histogram([v for v in values if v is not None], 4)[0].tolist()
    same = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert [r.n for r in stats.histogram(same, F.col("v"), 2).orderBy("bin").collect()] == [2, 0]


def test_two_tiers(spark):
    frame = spark.createDataFrame([("a", None), ("b", 0), ("c", 5), ("d", 9)], "k string, v bigint")
    assert [r.k for r in stats.two_tier_order(frame, "v", "k").collect()] == ["d", "c", "a", "b"]


def test_scale(spark):
    frame = spark.createDataFrame([(1.0,), (3.0,), (2.0,)], "v double")
    assert sorted(r.v for r in stats.scale_column(frame, "v").collect()) == pytest.approx([-1, 0, 1], abs=1e-6)


def test_last_wins(spark):
    rows = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "only")], "name string, at int, v string")
    found = {r.name: r.v for r in metadata.last_wins(rows, "name", ["at", "v"]).collect()}
    assert found == {"a": "new", "b": "only"}


def test_missing_keys_and_age(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    stored = spark.createDataFrame([("a", 1), ("b", 9)], "name string, at int")
    assert {r.name for r in metadata.missing_keys(wanted, stored, "name").collect()} == {"c"}
    aged = metadata.missing_keys(wanted, stored, "name", "at", F.lit(5))
    assert {r.name for r in aged.collect()} == {"a", "c"}


PACKAGE = {
    "name": "@s/x", "latest_version": "1.0", "description": None, "readme": "", "keywords": ["pi-package"],
    "author": "Ann", "license": None, "homepage": None, "repository": {"type": "git", "url": "https://github.com/o/x"},
    "pi": {"tools": ["a"], "video": "v"}, "time": {"created": "2026-01-01T00:00:00.000Z", "1.0": "2026-01-01T00:00:01.000Z"},
    "versions_count": 1, "downloads_last_week": None, "download_trend": [],
}


def test_package_files(spark, tmp_path):
    (tmp_path / "s__x.json").write_text(json.dumps(PACKAGE, indent=2))
    other = {**PACKAGE, "name": "y", "author": {"name": "Bo"}, "repository": "git@github.com:p/y.git"}
    (tmp_path / "y.json").write_text(json.dumps(other, indent=2))
    rows = {r.name: r for r in readers.read_packages(spark, str(tmp_path)).select(
        "name", F.col("time")["created"].alias("created"), F.size("download_trend").alias("points"),
        F.to_json("author").alias("author"),
    ).collect()}
    assert rows["@s/x"].points == 0 and rows["@s/x"].created.year == 2026
    assert rows["@s/x"].author == '"Ann"' and rows["y"].author == '{"name":"Bo"}'


def test_listing_file_is_an_array_and_last_wins(spark, tmp_path):
    listed = [
        {"name": "a", "publisher": "old", "date": "2026-01-01T00:00:00Z", "version": "1"},
        {"name": "a", "publisher": "new", "date": "2026-02-01T00:00:00Z", "version": "2"},
    ]
    (tmp_path / "packages.json").write_text(json.dumps(listed))
    assert [(r.name, r.publisher) for r in readers.read_listing(spark, str(tmp_path)).collect()] == [("a", "new")]


def test_search_page_with_missing_people(spark):
    page = {"total": 1, "objects": [{"package": {"name": "a", "publisher": None, "author": None}}]}
    frame = spark.createDataFrame([(json.dumps(page),)], "body string")
    pages = frame.select(F.from_json("body", schemas.SEARCH_PAGE).alias("p")).select("p.*")
    row = readers.normalise_listing(pages).first()
    assert (row.name, row.publisher, row.author, row.keywords, row.links) == ("a", None, None, [], {})


def test_repository_files_are_keyed_by_name(spark, tmp_path):
    (tmp_path / "o__x.json").write_text(json.dumps({"stargazers_count": 3, "pushed_at": "not a time"}))
    row = metadata.repository_columns(readers.read_repositories(spark, str(tmp_path))).first()
    assert (row.slug, row.stars, row.is_fork, row.pushed_at) == ("o__x", 3, False, None)


def test_gzip_round_trip(spark):
    frame = spark.createDataFrame([("a", [("b", 0.5)])], "name string, similar array<struct<name:string,score:double>>")
    path = fresh_path(spark, "gz")
    writers.write_json(frame, path, compress=True)
    assert spark.read.schema(frame.schema).json(path).collect() == frame.collect()
    files = spark.read.json(path).inputFiles()
    assert files and all(f.endswith(".json.gz") for f in files)


def test_vector_cache_grows(spark):
    path = fresh_path(spark, "vectors")
    old = spark.createDataFrame([("a", [1.0])], schemas.EMBEDDING)
    new = spark.createDataFrame([("a", [9.0]), ("b", [2.0])], schemas.EMBEDDING)
    writers.append_vectors(old, path)
    writers.append_vectors(metadata.missing_keys(new, readers.read_embeddings(spark, path), "name"), path)
    assert {r.name: r.vec for r in readers.read_embeddings(spark, path).collect()} == {"a": [1.0], "b": [2.0]}


def test_stream_picks_up_new_files_once(spark, tmp_path):
    source, out, state = tmp_path / "in", fresh_path(spark, "out"), fresh_path(spark, "state")
    frame = spark.range(5).select("id")
    frame.write.parquet(str(source))
    stream = landing.landed(spark, str(source), frame.schema)
    landing.store_available(stream, out, state)
    landing.store_available(stream, out, state)
    assert spark.read.parquet(out).count() == 5
    spark.range(5, 8).select("id").write.mode("append").parquet(str(source))
    landing.store_available(stream, out, state)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(8))


def test_staged_rows_equal_their_source(spark):
    frame = spark.range(10).select("id", F.array("id").alias("a"))
    assert sorted(stage(frame, "t").collect()) == sorted(frame.collect())


@pytest.mark.parametrize("level", [8, 64, 1 << 14])
def test_quantiles_from_brackets(spark, monkeypatch, level):
    """Small levels leave wide brackets; the second scan settles them all the same."""
    monkeypatch.setattr(quantiles, "LEVEL", level)
    rng = np.random.default_rng(level)
    values = np.concatenate([rng.normal(size=900), np.full(500, 0.25), rng.integers(0, 5, 300), [math.inf, -math.inf]])
    frame = spark.createDataFrame([(float(v),) for v in values] + [(None,), (math.nan,)], "v double").repartition(5)
    shares = [0.0, 0.01, 0.25, 0.25, 0.5, 0.77, 0.999, 1.0]
    ordered = np.sort(values)
    wanted = []
    for q in shares:
        at = q * (len(ordered) - 1)
        low, high = ordered[math.floor(at)], ordered[min(math.floor(at) + 1, len(ordered) - 1)]
        wanted.append(low if at == math.floor(at) or low == high else low + (high - low) * (at - math.floor(at)))
    assert quantiles.exact_quantiles(frame, "v", shares) == pytest.approx(wanted)
    every, stands, error = quantiles.sketch(frame.filter("v is not null and not isnan(v)"))
    assert stands.sum() == len(values) and (error == 0) == (level > len(values))
    for v in (-1.0, 0.25, 2.0):
        assert abs(stands[every <= v].sum() - (values <= v).sum()) <= error


def test_the_table_is_scanned_twice(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quantiles, "LEVEL", 32)
    spark.range(5000).select(F.col("id").cast("double").alias("v")).write.parquet(str(tmp_path / "t"))
    frame, scans = spark.read.parquet(str(tmp_path / "t")), []
    for name in ("sketch", "at_ranks"):
        own = getattr(quantiles, name)
        monkeypatch.setattr(quantiles, name, lambda values, *a, own=own: scans.append(values) or own(values, *a))
    assert quantiles.exact_quantiles(frame, "v", [0.1, 0.5, 0.9]) == pytest.approx([499.9, 2499.5, 4499.1])
    assert len(scans) == 2


def test_histograms_share_their_scans(spark):
    values = [0.0, 1.0, 1.0, 2.5, None]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    both = stats.histograms(frame, {"a": F.col("v"), "b": F.col("v") * 2, "none": F.lit(None).cast("double")}, 5)
    for name, scale in (("a", 1), ("b", 2)):
        found = both.filter(F.col("view") == name).orderBy("bin").collect()
        counts, edges = np.histogram([v * scale for v in values if v is not None], 5)
        assert [r.n for r in found] == counts.tolist() and [r.edge for r in found] == pytest.approx(edges[:-1].tolist())
    assert [tuple(r)[1:] for r in both.filter("view = 'none'").orderBy("bin").collect()] == [(i, None, 0) for i in range(5)]
