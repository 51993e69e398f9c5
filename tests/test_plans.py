"""Shapes of physical plans that must hold at any scale."""

import time

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import tfidf
from shelfmark.plans import workload
from shelfmark.plans.workload import QUERIES
from shelfmark.session import stage
from shelfmark.streaming import landing


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["q03_top_downloads", "q07_weekly_grid", "q21_near_dup", "q24_similar", "q25_assign", "q34_mentions", "q44_scale"]
)
def test_no_nested_loops(spark, sf_dir, name):
    plan = physical(QUERIES[name](spark, sf_dir))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("name", ["q10_last_26", "q24_similar", "q29b_cluster_words", "q43_word_weights"])
def test_rankings_are_cut_before_the_shuffle_or_sort(spark, sf_dir, name):
    assert "WindowGroupLimit" in physical(QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["q02_top_publishers", "q03_top_downloads", "q37_keyword_counts"])
def test_reports_keep_only_their_rows(spark, sf_dir, name):
    assert "TakeOrderedAndProject" in physical(QUERIES[name](spark, sf_dir))


def test_scans_read_only_what_is_used(spark, sf_dir):
    plan = QUERIES["q05_weekly_buckets"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "l_comment" not in plan


def test_unseen_rows_of_a_stream(spark, tmp_path):
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    frame = spark.range(6).select(F.col("id").cast("string").alias("name"))
    frame.write.parquet(source)
    stored = frame.filter("name < '3'")
    stream = landing.landed(spark, source, frame.schema)
    landing.store_available(landing.unseen(stream, stored, "name"), out, state)
    assert sorted(r.name for r in spark.read.parquet(out).collect()) == ["3", "4", "5"]


def test_every_landed_document_is_a_row_of_its_own(spark, tmp_path):
    rows = [(k, f"Supplier {k}", k % 25) for k in range(1, 131)]
    suppliers = spark.createDataFrame(rows, "s_suppkey bigint, s_name string, s_nationkey int")
    suppliers.write.parquet(f"{tmp_path}/supplier.parquet")
    found = workload.q45_landed_documents(spark, str(tmp_path)).collect()
    assert sum(r.corrupt for r in found) == 13
    assert sorted(int(r.name) for r in found if not r.corrupt) == [k for k in range(1, 131) if k % 10]


def test_the_pair_total_folds_its_vectors_once(spark, tmp_path):
    texts = ["river stone"] * 3 + ["lamp chair"] * 2 + ["window"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    total = QUERIES["q21d_pair_total"](spark, str(tmp_path))
    assert total.collect() == [(4,)]
    assert "keys=[idx" not in physical(total)  # the folded vectors are read


def test_entries_are_shuffled_once_to_meet_an_unbounded_vocabulary(spark):
    docs = spark.createDataFrame([(i, f"river stone{i % 9} lamp{i}") for i in range(600)], "id bigint, text string")
    model = tfidf.fit(docs, "id", F.col("text"), tfidf.Vocabulary())
    rows = model.vectors.select("id", F.explode("idx").alias("idx"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        joined = tfidf._join_terms(rows, model.terms, "idx", ["term"], False)
        assert physical(joined).count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert joined.count() == rows.count() == 1800


def test_what_a_write_shuffled_is_deleted(spark):
    def shuffled():
        blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks()
        return {name for n in range(blocks.size()) if (name := blocks.apply(n).name()).startswith("shuffle_")}

    before = shuffled()
    counted = stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    for _ in range(50):  # it is deleted in the background
        if not (left := shuffled() - before):
            break
        time.sleep(0.1)
    assert not left and counted.count() == 7
