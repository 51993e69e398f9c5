"""The operators run over the benchmark tables, one entry per query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfmark.functions import catalogue, fixed, numeric, text as text_functions
from shelfmark.operators import clusters, graph, kmeans, layout, metadata, quantiles, similarity, stats, tfidf, trends
from shelfmark.session import fresh_path, stage, widen
from shelfmark.plans import catalogue as catalogue_plan
from shelfmark.sources import readers, schemas, writers
from shelfmark.streaming import buckets, landing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

NEAR_DUPLICATE = 0.8
PRUNE_AT = 0.0
CACHE_BUCKETS = 8
ROWS_PER_FILE = 500
AS_OF = "2024-04-30 06:00:00"
TYPE_WORDS = ("kw-small", "kw-bolt", "kw-red", "kw-gear")
AUDIENCE_WORDS = ("src3", "fr")
AUDIENCE_PHRASES = ("ing the", "tion of", " the ", "que ", " der ", " los ")
ORIGIN_PHRASES = ("licen[sc]ed? under", "copyright", "rights reserved", "credits? to", "see also")
BOTS = ("NATION_1", "NATION_2", "NATION_3", "GitHub Actions")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Counts, rankings, distributions


@query
def q01_declared_type(spark, sf):
    words = F.transform(F.split("p_name", " "), lambda w: F.concat(F.lit("kw-"), w))
    typed = table(spark, sf, "part").select(catalogue.declared_type(words, TYPE_WORDS, "kw-").alias("type"))
    return stats.value_counts(typed, "type")


@query
def q02_top_publishers(spark, sf):
    top = stats.top_values(table(spark, sf, "orders"), "o_custkey")
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    named = metadata.label_top(top, names, "o_custkey")
    return named.select(F.col("c_name").alias("publisher"), "o_custkey", "n")


@query
def q03_top_downloads(spark, sf):
    totals = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("downloads"))
    top = stats.top_rows(totals, "downloads", "l_partkey", 20)
    types = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return metadata.label_top(top, types, "l_partkey")


@query
def q04_distribution(spark, sf):
    events = table(spark, sf, "events")
    p95 = stats.exact_quantile(events, "value", 0.95)
    views = {
        "linear": F.col("value"),
        "plus_one": numeric.shifted(F.col("value")),
        "clip_p95": numeric.clip(F.col("value"), high=p95),
    }
    return stats.histograms(events, views).withColumn("edge", numeric.half_even(F.col("edge"), 6))


@query
def q04b_quantiles(spark, sf):
    shares = (0.0, 0.25, 0.5, 0.95, 1.0)
    values = quantiles.exact_quantiles(table(spark, sf, "lineitem"), "l_extendedprice", shares)
    found = spark.createDataFrame(list(zip(shares, values)), "q double, x double")
    return found.select("q", numeric.half_even(F.col("x"), 4).alias("x"))


# Weekly series


def returned_weekly(spark, sf) -> DataFrame:
    items = table(spark, sf, "lineitem")
    returned = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)
    daily = trends.daily_totals(items.select("l_suppkey", "l_shipdate", returned.alias("q")), "l_suppkey", "l_shipdate", "q")
    return trends.positional_buckets(daily, "l_suppkey")


@query
def q05_weekly_buckets(spark, sf):
    return returned_weekly(spark, sf)


@query
def q05b_streamed_buckets(spark, sf):
    """The buckets of daily counts that land in two parts: the second run goes on where the first ended."""
    items = table(spark, sf, "lineitem")
    returned = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)
    daily = trends.daily_totals(items.select("l_suppkey", "l_shipdate", returned.alias("q")), "l_suppkey", "l_shipdate", "q")
    daily = stage(daily, "daily")
    first, last = daily.agg(F.min("day"), F.max("day")).first()
    landed, out, state = (fresh_path(spark, name) for name in ("days", "buckets", "buckets-state"))
    middle = first + (last - first) / 2 if first else None
    for part in (F.col("day") <= F.lit(middle), F.col("day") > F.lit(middle)):
        daily.filter(part).coalesce(4).write.mode("append").parquet(landed)
        stream = landing.landed(spark, landed, daily.schema)
        buckets.store_positional(stream, out, state, "l_suppkey")
    stored = buckets.stored(spark, out, buckets.shape("l_suppkey", daily.schema["l_suppkey"].dataType))
    return buckets.latest(stored, "l_suppkey")


@query
def q06_weekly_total(spark, sf):
    return trends.weekly_totals(returned_weekly(spark, sf))


@query
def q07_weekly_grid(spark, sf):
    weekly = stage(returned_weekly(spark, sf), "weekly")
    totals = weekly.groupBy("l_suppkey").agg(F.sum("downloads").alias("total"))
    top = trends.top_with_trend(totals, weekly, "l_suppkey", "total")
    return trends.weekly_grid(weekly, "l_suppkey", top)


@query
def q08_trend_positive(spark, sf):
    weekly = returned_weekly(spark, sf)
    return trends.trajectories(weekly, "l_suppkey", positive_only=True, growth=1.05, decline=0.95)


@query
def q09_trend_all(spark, sf):
    return trends.trajectories(returned_weekly(spark, sf), "l_suppkey", growth=1.05, decline=0.95)


@query
def q10_last_26(spark, sf):
    return trends.last_points(returned_weekly(spark, sf), "l_suppkey")


# Keyed joins and record fields


def labelled_documents(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    joined = docs.join(table(spark, sf, "labels"), "doc_id", "left")
    return joined.withColumn("toxic", F.coalesce(F.col("toxic") == 1, F.lit(False)))


@query
def q11_attach_metadata(spark, sf):
    return labelled_documents(spark, sf)


@query
def q11b_coverage(spark, sf):
    return stats.coverage(
        labelled_documents(spark, sf),
        with_label=F.col("quality").isNotNull(),
        good=F.col("quality") == 1,
        toxic=F.col("toxic"),
    )


@query
def q11c_top_labelled(spark, sf):
    known = labelled_documents(spark, sf).dropna(subset=["quality"])
    return stats.top_rows(known, "n_chars", "doc_id", 20)


@query
def q12_freshness(spark, sf):
    seen = table(spark, sf, "events").groupBy("user_id").agg(
        F.max("ts").alias("last_seen"), F.count("*").alias("n")
    )
    as_of = F.to_timestamp_ntz(F.lit(AS_OF))
    return metadata.stale(seen, "last_seen", as_of, "n", "user_id").select("user_id", "days", "n")


@query
def q13_url_parts(spark, sf):
    url = F.col("url")
    options = {"host": r"example\.\w+", "suffix": r"\.html"}
    return (
        table(spark, sf, "pages")
        .select(
            "page_id",
            catalogue.repository_part(url, "owner", **options).alias("owner"),
            catalogue.repository_part(url, "repo", **options).alias("repo"),
            catalogue.repository_slug(url, **options).alias("slug"),
        )
        .filter(F.col("slug").isNotNull())
    )


@query
def q14_name_tokens(spark, sf):
    name = F.concat(F.lit("@"), F.col("p_brand"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")))
    return table(spark, sf, "part").select(
        "p_partkey",
        catalogue.name_words(name, affix="small").alias("words"),
        catalogue.safe_key(name).alias("safe_key"),
    )


@query
def q15_best_label(spark, sf):
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = metadata.attach(table(spark, sf, "customer"), nations, "c_nationkey", "c_custkey")
    url = F.when(
        F.col("c_nationkey") % 5 == 0,
        F.concat(F.lit("git+https://github.com/"), F.lower("c_mktsegment"), F.lit("/x.git")),
    )
    publisher = F.when(F.col("c_nationkey") % 2 == 0, F.col("n_name"))
    author = F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).otherwise("GitHub Actions")
    owner = catalogue.repository_part(url, "owner")
    return rows.select("c_custkey", catalogue.best_author(owner, publisher, author, BOTS).alias("author"))


@query
def q16_multi_flag(spark, sf):
    docs = widen(table(spark, sf, "documents").select("doc_id", "lang", "source", "text"), "doc_id")
    flag = catalogue.serves_several(
        F.array("lang", "source"), F.col("source"), F.col("text"), AUDIENCE_WORDS, AUDIENCE_PHRASES
    )
    return docs.select("doc_id", flag.alias("several"))


@query
def q17_compact(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    joined = docs.join(table(spark, sf, "labels"), "doc_id", "left")
    words = F.array("lang", F.lit("doc"), "source")
    return joined.select(
        F.col("doc_id").alias("n"),
        text_functions.lead(F.col("text"), 200).alias("d"),
        catalogue.declared_type(words, ("en", "fr"), "").alias("t"),
        F.array_join(catalogue.visible_keywords(words, hidden=("doc", "en", "fr")), ",").alias("kw"),
        text_functions.lead(F.col("text"), 200, one_line=True).alias("rm"),
        F.col("n_chars").alias("dl"),
        F.col("quality").alias("st"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("fk"),
    )


def landed_catalogue(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(packages, listing, repositories) of a catalogue of the pages; repositories come from landed side files."""
    i = F.col("page_id")
    at = lambda days: F.timestamp_seconds(1_704_067_200 + 86_400 * days)
    weekly = returned_weekly(spark, sf).select(
        F.col("l_suppkey").cast("string").alias("name"), "week_end", F.floor("downloads").alias("downloads")
    )
    marker = F.get(F.array(*[F.lit(m) for m in fixed.TYPE_MARKERS]), (i % 3).cast("int"))
    link = F.concat(F.lit("git+https://github.com/o"), i % 5, F.lit("/r"), i % 7, F.lit(".git"))
    packages = table(spark, sf, "pages").select(
        i.cast("string").alias("name"), F.concat(F.lit("1."), i % 7).alias("latest_version"), F.col("url").alias("description"),
        F.col("html").alias("readme"),
        F.array(
            F.lit(fixed.CATALOGUE_KEYWORD), F.concat(F.lit("k"), i % 11), F.when(i % 2 == 0, marker).otherwise("plain"),
            F.when(i % 13 == 0, F.lit(fixed.MULTI_KEYWORDS[0])).otherwise("other"),
        ).alias("keywords"),
        F.parse_json(F.concat(F.lit('{"name":"author '), i % 6, F.lit('"}'))).alias("author"),
        F.when(i % 4 != 0, F.parse_json(F.concat(F.lit('{"url":"'), link, F.lit('"}')))).alias("repository"),
        F.create_map(F.lit("created"), at(i), F.lit("modified"), at(i * 2)).alias("time"),
    )
    customer = table(spark, sf, "customer")
    listing = customer.select(
        F.col("c_custkey").cast("string").alias("name"),
        F.when(F.col("c_nationkey") % 3 == 0, F.lit(fixed.CI_ACCOUNTS[0])).otherwise(F.col("c_name")).alias("publisher"),
    )
    # 25 of the 35 repositories have a file
    k = F.col("n_nationkey")
    parent = F.struct(F.concat(F.lit("up/"), F.col("n_name")).alias("full_name"), F.lit("https://up").alias("html_url"))
    body = F.to_json(F.struct(
        (k * 10 + F.col("n_regionkey")).alias("stargazers_count"), k.alias("forks_count"), (k % 3).alias("open_issues_count"),
        k.alias("watchers_count"), (k % 4 == 0).alias("fork"),
        F.when(k % 5 == 1, F.lit("not a moment")).otherwise(F.concat(F.lit("2024-01-"), F.lpad((k + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z"))).alias("pushed_at"),
        F.when(k % 4 == 0, parent).alias("parent"),
    ))
    path = fresh_path(spark, "repositories")
    slug = F.concat(F.lit("o"), k % 5, F.lit("__r"), k % 7)
    writers.write_named(table(spark, sf, "nation").select(slug.alias("slug"), body.alias("body")), path, "slug", "body")
    return readers.with_downloads(packages, weekly), listing, readers.read_repositories(spark, path)


def page_spots(spark, sf) -> DataFrame:
    """(name, x, y): two axes of the embeddings, scaled."""
    axes = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("name"), *[F.col("embedding")[n].cast("double").alias(c) for n, c in enumerate("xy")]
    )
    for c in "xy":
        axes = stats.scale_column(axes, c).withColumn(c, numeric.half_even(F.col(c), 4))
    return axes


def page_lists(spark, sf) -> catalogue_plan.Graph:
    edges = stage(page_graph(spark, sf), "edges")
    named = lambda df: df.withColumn("src", F.col("src").cast("string")).withColumn("dst", F.col("dst").cast("string"))
    return catalogue_plan.Graph(named(edges), named(similarity.similar_lists(edges)))


def listed_names(similar: Column) -> Column:
    """Names with their scores in thousandths, in order."""
    entry = lambda s: F.concat(s["name"], F.lit(":"), F.round(s["score"] * 1000).cast("bigint"))
    return F.array_join(F.transform(similar, entry), ",")


@query
def q17b_serving(spark, sf):
    """All twenty fields of the serving records, with the listing, side files, series, lists and coordinates joined."""
    packages, listing, repositories = landed_catalogue(spark, sf)
    recs = catalogue_plan.records(packages, listing, repositories)
    served = catalogue_plan.serving(recs, page_lists(spark, sf), page_spots(spark, sf))
    return served.withColumns({
        "tr": F.array_join(F.transform("tr", lambda v: v.cast("string")), ","), "si": listed_names(F.col("si")),
        "kw": F.array_join("kw", ","), **{c: F.unix_timestamp(c) for c in ("pa", "dt", "dc")},
    })


@query
def q18b_published(spark, sf):
    """All datasets of the catalogue, written in one step and read back."""
    packages, listing, repositories = landed_catalogue(spark, sf)
    recs = catalogue_plan.records(packages, listing, repositories)
    found = page_lists(spark, sf)
    meta = clusters.cluster_meta(brand_members(spark, sf), "downloads", "p_brand", 0.019, 0.017)
    words = clusters.cluster_words(
        table(spark, sf, "documents").select(F.col("lang").alias("cluster"), text_functions.naming_words(F.lit(""), F.col("text")).alias("words"))
    )
    described = catalogue_plan.Clusters(meta, meta, meta, words)
    paths = catalogue_plan.publish(
        recs, packages, found, described, cross_referenced(spark, sf), fresh_path(spark, "published"), page_spots(spark, sf)
    )
    similar = "array<struct<name string, score double>>"
    shapes = {
        "serving": ("n string, t string, p string, st bigint", F.col("n"), F.concat_ws("|", "t", "p", "st")),
        "full": (
            f"name string, github struct<stars bigint, is_fork boolean>, similar {similar}", F.col("name"),
            F.concat_ws("|", "github.stars", "github.is_fork", listed_names(F.col("similar"))),
        ),
        "clusters": ("p_brand string, members bigint, pattern string", F.col("p_brand"), F.concat_ws("|", "members", "pattern")),
        "cluster-words": ("cluster string, word string, rank int", F.concat_ws("|", "cluster", "rank"), F.col("word")),
        "references": ("id bigint, mentions array<string>", F.col("id").cast("string"), F.size("mentions").cast("string")),
    }
    edge = spark.read.parquet(paths["edges"])
    out = edge.select(
        F.lit("edges").alias("dataset"), F.concat_ws("|", "src", "dst").alias("key"),
        F.round(F.col("score") * 1000).cast("bigint").cast("string").alias("detail"),
    )
    for name, (shape, key, detail) in shapes.items():
        rows = spark.read.schema(shape).json(paths[name])
        out = out.unionByName(rows.select(F.lit(name).alias("dataset"), key.alias("key"), detail.alias("detail")))
    return out


@query
def q18_full_nested(spark, sf):
    docs = table(spark, sf, "documents")
    label = F.struct("quality", "toxic")
    edges = graph.copy_edges(docs, "doc_id", "text").withColumnRenamed("child", "doc_id")
    full = (
        docs.join(table(spark, sf, "labels").select("doc_id", label.alias("label")), "doc_id", "left")
        .join(edges, "doc_id", "left")
    )
    path = fresh_path(spark, "full")
    writers.write_json(full, path, compress=True)
    return spark.read.schema(full.schema).json(path).select("doc_id", "lang", "label.quality", "parent", "text")


# Words and similarity


@query
def q19_doc_freq(spark, sf):
    docs = widen(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    words = docs.select(text_functions.folded_words(F.col("text")).alias("words"))
    return stats.document_frequency(words, "words", fixed.FREQUENCY_STOP_WORDS)


def document_model(spark, sf, terms=tfidf.NEAR_DUPLICATES) -> tfidf.Model:
    return tfidf.fit(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", F.col("text"), terms)


@query
def q20_tfidf_terms(spark, sf):
    weighted = tfidf.weights(document_model(spark, sf))
    return weighted.select("id", "term", numeric.half_even(F.col("weight"), 6).alias("weight"))


UNCAPPED = tfidf.Vocabulary(ngrams=(1, 2))
WITHOUT_COMMON = tfidf.Vocabulary(max_features=500, max_df=0.2)


@query
def q20b_uncapped_terms(spark, sf):
    """Vectors over all words and word pairs of the corpus, by document."""
    weighted = tfidf.weights(document_model(spark, sf, UNCAPPED))
    return weighted.groupBy("id").agg(
        F.count("*").alias("terms"), numeric.half_even(F.max("weight"), 6).alias("heaviest"),
        numeric.half_even(F.sum("weight"), 6).alias("total"),
    )


@query
def q20c_without_common(spark, sf):
    """Weights over a vocabulary without the words of more than a fifth of the documents."""
    weighted = tfidf.weights(document_model(spark, sf, WITHOUT_COMMON))
    return weighted.select("id", "term", numeric.half_even(F.col("weight"), 6).alias("weight"))


@query
def q21_near_dup(spark, sf):
    pairs = similarity.near_pairs(document_model(spark, sf).vectors, NEAR_DUPLICATE, every=True)
    sizes = table(spark, sf, "documents").select("doc_id", "n_chars")
    sized = similarity.join_small(pairs, sizes.toDF("id_a", "chars_a"), "id_a")
    sized = similarity.join_small(sized, sizes.toDF("id_b", "chars_b"), "id_b")
    return sized.withColumn("score", numeric.half_even(F.col("score"), 3))


@query
def q21b_near_dup_top(spark, sf):
    pairs = similarity.near_pairs(document_model(spark, sf).vectors, NEAR_DUPLICATE, every=True)
    top = pairs.orderBy(F.desc("score"), "id_a", "id_b").limit(20)
    return top.select("id_a", "id_b", numeric.half_even(F.col("score"), 3).alias("score"))


@query
def q21e_near_dup_published(spark, sf):
    """The published threshold."""
    pairs = similarity.near_pairs(document_model(spark, sf).vectors, fixed.NEAR_DUPLICATE_THRESHOLD)
    return pairs.withColumn("score", numeric.half_even(F.col("score"), 3))


@query
def q21f_near_dup_approximate(spark, sf):
    """Pairs from banded random projections, verified: all of them are in q21, and nearly all of q21's."""
    pairs = similarity.near_pairs(document_model(spark, sf).vectors, NEAR_DUPLICATE, similarity.Approximate())
    return pairs.withColumn("score", numeric.half_even(F.col("score"), 3))


@query
def q21c_copies(spark, sf):
    vectors = document_model(spark, sf).vectors
    members = similarity.fold_members(vectors, stage(similarity.fold_equal(vectors), "folded"))
    return members.filter(F.col("id") != F.col("rep"))


@query
def q21d_pair_total(spark, sf):
    vectors = document_model(spark, sf).vectors
    folded = stage(similarity.fold_equal(vectors), "folded")
    return similarity.pair_total(similarity.similar_pairs(vectors, NEAR_DUPLICATE, folded=folded), folded)


def page_graph(spark, sf) -> DataFrame:
    pages = table(spark, sf, "pages")
    address = tfidf.fit(
        pages.select("page_id", "url"), "page_id",
        F.regexp_replace("url", r"[^\p{L}\p{N}]+", " "), tfidf.SPECIFIC, "address",
    )
    prose = tfidf.fit(
        pages.select("page_id", "html"), "page_id", text_functions.plain_prose(F.col("html")), tfidf.PROSE, "prose"
    )
    vectors = stage(tfidf.blend(address, prose, fixed.SPECIFIC_WEIGHT, fixed.PROSE_WEIGHT), "blend")
    return similarity.nearest(vectors)


@query
def q22_hybrid_topn(spark, sf):
    return page_graph(spark, sf).withColumn("score", numeric.half_even(F.col("score"), 6))


@query
def q23_two_hop(spark, sf):
    hops = similarity.two_hop(stage(page_graph(spark, sf), "edges"))
    return hops.withColumn("score", numeric.half_even(F.col("score"), 6))


@query
def q24_similar(spark, sf):
    return similarity.similar_lists(stage(page_graph(spark, sf), "edges"))


# Clusters


@query
def q25_assign(spark, sf):
    points = table(spark, sf, "embeddings")
    centres = clusters.centroids(points, "label", "embedding")
    near = clusters.assign_nearest(points.select("vec_id", "embedding"), centres, "label", "embedding")
    return near.select("vec_id", "nearest", numeric.half_even(F.col("distance"), 6).alias("distance"))


@query
def q26_kmeans_fit(spark, sf):
    points = table(spark, sf, "embeddings")
    model = kmeans.fit(points, "embedding", fixed.VECTOR_CLUSTERS, fixed.VECTOR_RESTARTS, fixed.VECTOR_ITERATIONS)
    return kmeans.assign(model, points, "embedding").select("vec_id", "cluster")


@query
def q26b_text_clusters(spark, sf):
    model = document_model(spark, sf)
    right, _ = layout.components(model.vectors, model.terms.count(), fixed.REDUCED_DIMENSIONS)
    reduced = stage(layout.project(model.vectors, right), "reduced")
    fitted = kmeans.fit(reduced, "point", fixed.TEXT_CLUSTERS, fixed.TEXT_RESTARTS)
    return kmeans.assign(fitted, reduced, "point").select("id", "cluster")


@query
def q27_cohesion(spark, sf):
    found = clusters.cohesion(table(spark, sf, "embeddings"), "label", "embedding", "vec_id")
    return found.withColumn("cohesion", numeric.half_even(F.col("cohesion"), 8))


@query
def q27b_cohesion_sample(spark, sf):
    found = clusters.cohesion(
        table(spark, sf, "embeddings"), "label", "embedding", "vec_id", sample=fixed.COHESION_SAMPLE
    )
    return found.withColumn("cohesion", numeric.half_even(F.col("cohesion"), 8))


@query
def q28_prune(spark, sf):
    points = table(spark, sf, "embeddings")
    tight = clusters.cohesion(points, "label", "embedding", "vec_id")
    return clusters.prune(points.select("vec_id", "label"), tight, "label", PRUNE_AT)


@query
def q28b_named_clusters(spark, sf):
    """Every record with its pruned cluster and that cluster's name; a cluster that was pruned away has none."""
    points = table(spark, sf, "embeddings")
    tight = clusters.cohesion(points, "label", "embedding", "vec_id")
    labels = stage(clusters.prune(points.select("vec_id", "label"), tight, "label", PRUNE_AT), "labels")
    largest = labels.groupBy(F.col("label").alias("cluster")).agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    names = largest.select("cluster", F.concat_ws(" / ", F.lit("Vectors"), "n", "first").alias("cluster_name"))
    return clusters.attach_names(labels, names, "vec_id", "label")


@query
def q29_cluster_names(spark, sf):
    docs = widen(table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars"), "doc_id")
    prepared = docs.select(
        F.col("lang").alias("cluster"),
        F.concat("source", F.lit("/pi-"), F.col("doc_id").cast("string")).alias("name"),
        "n_chars",
        text_functions.naming_words(F.lit(""), F.col("text")).alias("words"),
    )
    words = clusters.cluster_words(prepared)
    return clusters.cluster_names(prepared, words, "name", "n_chars")


@query
def q29b_cluster_words(spark, sf):
    docs = widen(table(spark, sf, "documents").select("doc_id", "text", "lang"), "doc_id")
    words = text_functions.naming_words(F.lit(""), F.col("text"))
    return clusters.cluster_words(docs.select(F.col("lang").alias("cluster"), words.alias("words")))


def language_labels(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("cluster"))


@query
def q30_relative_words(spark, sf):
    model = document_model(spark, sf, tfidf.CLUSTER_WORDS)
    return clusters.relative_words(model, language_labels(spark, sf), model.n_docs)


def brand_members(spark, sf) -> DataFrame:
    sold = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.sum("l_quantity").alias("downloads")
    )
    return table(spark, sf, "part").select("p_partkey", "p_name", "p_brand").join(sold, "p_partkey", "left")


@query
def q31_cluster_meta(spark, sf):
    return clusters.cluster_meta(brand_members(spark, sf), "downloads", "p_brand", 0.019, 0.017).withColumn(
        "ratio", numeric.half_even(F.col("ratio"), 2)
    )


@query
def q31b_largest_clusters(spark, sf):
    """Clusters by their total, the largest first, cut."""
    meta = clusters.cluster_meta(brand_members(spark, sf), "downloads", "p_brand", 0.019, 0.017)
    return meta.withColumn("ratio", numeric.half_even(F.col("ratio"), 2)).orderBy(F.desc("total"), "p_brand").limit(10)


@query
def q32_drilldown(spark, sf):
    members = brand_members(spark, sf)
    meta = clusters.cluster_meta(members, "downloads", "p_brand", 0.019, 0.017)
    return clusters.drill_down(meta, members, "p_partkey", "downloads", "p_brand")


@query
def q32b_top_terms(spark, sf):
    model = document_model(spark, sf)
    terms = clusters.top_terms(model, language_labels(spark, sf))
    lists = clusters.term_lists(terms)
    return lists.select("cluster", "label", F.array_join(F.slice("terms", 1, 4), ", ").alias("top_terms"))


@query
def q33_layout(spark, sf):
    model = document_model(spark, sf)
    return layout.plane(model.vectors, model.terms.count())


# Edges


@query
def q34_mentions(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    return graph.mentions(docs, items, "doc_id", "text", "text", exclude_self=False)


def conversation_words(spark, sf) -> DataFrame:
    words = table(spark, sf, "conversations").select(
        F.explode(text_functions.tokens(F.col("text"), pattern=r"[\p{L}]{5,}")).alias("name")
    )
    return words.distinct()


@query
def q34b_word_mentions(spark, sf):
    """All words of the conversations, as whole words in documents."""
    docs, names = table(spark, sf, "documents"), conversation_words(spark, sf)
    return graph.mentions(docs, names, "doc_id", "text", "name", mode="word", exclude_self=False)


@query
def q34c_sliced_mentions(spark, sf):
    """All words of the conversations, anywhere in page addresses, with a dictionary cut into slices."""
    pages, names = table(spark, sf, "pages"), conversation_words(spark, sf)
    return graph.mentions(pages, names, "page_id", "url", "name", exclude_self=False, slice_chars=10_000)


def cross_referenced(spark, sf) -> DataFrame:
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    lines = graph.origin_lines(docs, "doc_id", "text", ORIGIN_PHRASES)
    named = graph.mention_lists(graph.mentions(docs, items, "doc_id", "text", "text", exclude_self=False))
    return graph.cross_references(docs, "doc_id", "n_chars", lines, named)


def short_references(found: DataFrame) -> DataFrame:
    return found.select(
        "id",
        "n_chars",
        F.array_join("origin_lines", "|").alias("origin_lines"),
        F.size("mentions").alias("mentions"),
    )


@query
def q35_cross_refs(spark, sf):
    return short_references(cross_referenced(spark, sf))


@query
def q35b_largest_cross_refs(spark, sf):
    """Cross references by size, the largest first, cut."""
    found = short_references(cross_referenced(spark, sf))
    return found.orderBy(F.coalesce("n_chars", F.lit(0)).desc(), "id").limit(20)


@query
def q36_copy_edges(spark, sf):
    return graph.copy_edges(table(spark, sf, "documents"), "doc_id", "text")


@query
def q36b_fork_edges(spark, sf):
    owner = F.concat(F.lit("owner__"), F.col("n_name"))
    regions = table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    repositories = table(spark, sf, "nation").join(regions, "n_regionkey").select(
        owner.alias("slug"),
        (F.col("n_regionkey") < 3).alias("is_fork"),
        F.struct(F.col("r_name").alias("full_name"), F.lit(None).cast("string").alias("html_url")).alias("parent"),
        F.col("n_nationkey").alias("stars"),
        F.col("n_regionkey").alias("open_issues"),
        F.lit("2024-01-01").alias("pushed_at"),
    )
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), owner.alias("slug"))
    packages = table(spark, sf, "supplier").join(names, "s_nationkey").select(F.col("s_name").alias("name"), "slug")
    return graph.fork_edges(packages, repositories).orderBy(F.coalesce("stars", F.lit(0)).desc(), "package")


@query
def q37_keyword_counts(spark, sf):
    """The commonest words of documents with a prefix: there are far more of them than the report has rows."""
    words = table(spark, sf, "documents").select(F.split("text", r"\s+").alias("keywords"))
    return stats.occurrence_counts(words, "keywords", "th", "the")


# Ingest


@query
def q38_todo(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    stored = table(spark, sf, "labels")
    todo = metadata.missing_keys(docs, stored, "doc_id")
    return todo.withColumn("state", F.lit("todo")).unionByName(
        stored.select("doc_id", F.lit(None).cast("string").alias("source"), F.lit("stored").alias("state"))
    )


@query
def q38b_vector_cache(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    first = vectors.filter(F.col("label") < 5)
    path = fresh_path(spark, "cache")
    writers.append_vectors(first, path)
    cache = spark.read.schema(vectors.schema).parquet(path)
    grown = metadata.extend_cache(cache, vectors, "vec_id")
    return metadata.align(vectors, grown, "vec_id").select("vec_id", "label", F.size("embedding").alias("width"))


REFRESH_FROM = "2024-01-20 00:00:00"


@query
def q38c_refreshed_store(spark, sf):
    """A store by user that takes new users, and known ones after seven days, from two landings of events."""
    events = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type", "event_id")
    landed, out, state = (fresh_path(spark, name) for name in ("events", "store", "store-state"))
    edge = F.lit(REFRESH_FROM).cast("timestamp_ntz")
    for part in (F.col("ts") < edge, F.col("ts") >= edge):
        events.filter(part).coalesce(1).write.mode("append").parquet(landed)
        buckets.refresh_available(landing.landed(spark, landed, events.schema), out, state, "user_id", ["ts", "event_id"])
    return buckets.current(spark, out, events.schema, "user_id", ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query
def q38d_bucketed_cache(spark, sf):
    """A vector cache in buckets: growing it and matching records to it shuffle the other side only."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    path = fresh_path(spark, "vectors")
    name = "cache_" + path.rsplit("-", 1)[-1]
    writers.append_bucketed(vectors.filter(F.col("label") < 5), name, path, "vec_id", CACHE_BUCKETS)
    new = metadata.missing_keys(vectors, spark.table(name), "vec_id")
    writers.append_bucketed(stage(new, "new-vectors"), name, path, "vec_id", CACHE_BUCKETS)
    return metadata.align(vectors, spark.table(name), "vec_id").select("vec_id", "label", F.size("embedding").alias("width"))


@query
def q39_last_wins(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    last = metadata.last_wins(orders, "o_custkey", ["o_orderdate", "o_orderkey"])
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return customers.join(last, "o_custkey", "left").select(
        "c_name", "o_orderkey", F.col("o_orderpriority").alias("priority")
    )


@query
def q40_normalise(spark, sf):
    raw = F.when(F.col("event_type") == "click", F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))).otherwise(
        F.col("props")
    )
    value = F.parse_json(raw)
    return table(spark, sf, "events").select(
        "event_id",
        catalogue.text_or_field(value, "k").alias("text"),
        F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"),
    )


@query
def q40b_listing(spark, sf):
    package = F.struct(
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("description"),
        F.when(F.col("c_nationkey") > 5, F.struct(F.concat(F.lit("a"), F.col("c_nationkey")).alias("name"))).alias("author"),
        F.when(F.col("c_nationkey") < 20, F.struct(F.col("c_mktsegment").alias("username"))).alias("publisher"),
        F.array(F.col("c_mktsegment"), F.lit("x")).alias("keywords"),
        F.lit("1.0").alias("version"),
    )
    landed = table(spark, sf, "customer").select(F.to_json(F.struct(F.array(F.struct(package.alias("package"))).alias("objects"))).alias("body"))
    pages = landed.select(F.from_json("body", schemas.SEARCH_PAGE).alias("p")).select("p.*")
    rows = readers.normalise_listing(pages)
    return rows.select("name", "description", "author", "publisher", F.array_join("keywords", ",").alias("keywords"))


@query
def q40c_registry(spark, sf):
    latest = F.col("p_size").cast("string")
    # one document per part: version "0" and, unless it is the same, the version tagged latest
    body = F.concat(
        F.lit('{"name":"'), F.col("p_partkey"),
        F.lit('","dist-tags":{"latest":"'), latest,
        F.lit('"},"author":{"name":"'), F.col("p_brand"),
        F.lit('"},"versions":{"0":{},"'), latest,
        F.lit('":{"pi":{"video":"'), F.col("p_type"), F.lit('"}}}}'),
    )
    parts = table(spark, sf, "part")
    docs = parts.select(F.from_json(body, schemas.REGISTRY_DOCUMENT).alias("d"))
    return readers.normalise_registry(docs.select("d.*")).select(
        "name",
        "latest_version",
        catalogue.text_or_field(F.col("author"), "name").alias("author"),
        F.try_variant_get(catalogue.map_value(F.col("pi"), "video"), "$", "string").alias("video"),
        "versions_count",
    )


def land_arrays(rows: DataFrame, number, entry, per_file: int, path: str) -> None:
    """Files with an array of ``per_file`` documents each."""
    files = rows.groupBy(F.floor(number / per_file).alias("file")).agg(F.to_json(F.collect_list(entry)).alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)


@query
def q45_landed_documents(spark, sf):
    """One JSON document a file, every tenth malformed, read and compacted."""
    name = F.col("s_suppkey").cast("string")
    body = F.to_json(F.struct(
        name.alias("name"), F.col("s_name").alias("description"), F.concat(F.lit("body of "), F.col("s_name")).alias("readme"),
        F.array(F.lit("kw"), F.col("s_nationkey").cast("string")).alias("keywords"), F.lit("1.0").alias("latest_version"),
        F.col("s_nationkey").alias("versions_count"),
    ))
    # every tenth document is cut off
    value = F.when(F.col("s_suppkey") % 10 == 0, F.lit('{"name": ')).otherwise(body).alias("value")
    path = fresh_path(spark, "documents")
    suppliers = widen(table(spark, sf, "supplier"), "s_suppkey")
    suppliers.select(value).write.option("maxRecordsPerFile", 1).text(path)
    parsed = readers.read_documents(spark, path, schemas.PACKAGE, keep_corrupt=True)
    packages = readers.compact(parsed, fresh_path(spark, "packages"))
    return packages.select(
        "name", text_functions.compose(F.col("description"), F.col("readme")).alias("text"),
        F.array_join("keywords", ",").alias("keywords"), "versions_count",
        F.col(readers.CORRUPT).isNotNull().alias("corrupt"),
    )


@query
def q45b_landed_arrays(spark, sf):
    """Listing files that hold an array each; a name that is in several keeps its latest row."""
    entry = F.struct(
        F.concat(F.lit("seg "), F.col("c_mktsegment")).alias("name"), F.col("c_name").alias("description"),
        F.timestamp_seconds(F.col("c_custkey") * 86400).alias("date"), F.lit("1").alias("version"),
    )
    path = fresh_path(spark, "listing")
    land_arrays(table(spark, sf, "customer"), F.col("c_custkey"), entry, ROWS_PER_FILE, path)
    return readers.read_listing(spark, path).select("name", "description", F.col("date").cast("date").alias("date"))


@query
def q46_landed_downloads(spark, sf):
    """Daily files to weekly series, joined to the package rows."""
    daily = table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").cast("string").alias("name"), F.col("l_shipdate").cast("date").alias("day")
    ).agg(F.sum("l_quantity").cast("bigint").alias("downloads"))
    path = fresh_path(spark, "downloads")
    writers.write_json(daily, path)
    weekly = catalogue_plan.weekly_downloads(readers.read_downloads(spark, path))
    packages = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("name"), "s_name")
    known = readers.with_downloads(packages, weekly)
    tail = catalogue.tail_values(F.transform("download_trend", lambda p: p["downloads"]), 4)
    return known.select(
        "name", "s_name", "downloads_last_week", F.size("download_trend").alias("weeks"),
        F.array_join(tail.cast("array<string>"), ",").alias("last_weeks"),
    )


@query
def q41_stream_weekly(spark, sf):
    schema = table(spark, sf, "events").schema
    stream = landing.landed(spark, sf, schema, pattern="events.parquet")
    # windows start on the first day of the data
    weekly = landing.weekly_windows(stream, "ts", "event_type", "value", start="4 days")
    out, state = fresh_path(spark, "weekly"), fresh_path(spark, "weekly-state")
    landing.store_available(weekly, out, state)
    stored = spark.read.schema(weekly.schema).parquet(out)
    return stored.withColumn("total", numeric.half_even(F.col("total"), 4))


@query
def q42_two_tier(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return stats.two_tier_order(rows, "c_acctbal", "c_custkey")


@query
def q43_word_weights(spark, sf):
    return clusters.word_weights(table(spark, sf, "documents"), "doc_id", "text", "lang")


@query
def q43b_word_weights_all(spark, sf):
    """Word weights of the whole corpus."""
    found = clusters.word_weights(table(spark, sf, "documents"), "doc_id", "text")
    return found.select("word", "n", "rank", "weight")


@query
def q44_scale(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "value")
    scaled = stats.scale_column(rows, "value")
    return scaled.withColumn("value", numeric.half_even(F.col("value"), 8))
