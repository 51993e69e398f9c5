"""TF-IDF, cosine joins and the two-hop graph against brute force."""

import math
import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark import session
from shelfmark.operators import heavy, similarity, tfidf, tiles


def corpus(seed, n, vocabulary=40, copies=0.3):
    rng = random.Random(seed)
    words = [f"w{i:02d}" for i in range(vocabulary)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < copies:
            texts.append(rng.choice(texts[: max(1, len(texts) // 3)]))
        else:
            texts.append(" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(vocabulary)], k=rng.randint(1, 12))))
    return [(i, t) for i, t in enumerate(texts)]


TERMS = tfidf.Vocabulary(max_features=200, ngrams=(1, 2), stop_words=("w01",))


def brute_vectors(rows, terms):
    counts = {}
    for i, text in rows:
        tokens = [t for t in text.split() if t not in terms.stop_words]
        grams = tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])]
        tally = defaultdict(int)
        for g in grams:
            tally[g] += 1
        counts[i] = tally
    df, total = defaultdict(int), defaultdict(int)
    for tally in counts.values():
        for term, tf in tally.items():
            df[term] += 1
            total[term] += tf
    kept = sorted((t for t in df if df[t] >= terms.min_df), key=lambda t: (-total[t], t))[: terms.max_features]
    idf = {t: math.log((1 + len(rows)) / (1 + df[t])) + 1 for t in kept}
    out = {}
    for i, tally in counts.items():
        raw = {t: tf * idf[t] for t, tf in tally.items() if t in idf}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        if norm:
            out[i] = {t: v / norm for t, v in raw.items()}
    return out


def cosine(a, b):
    return round(sum(w * b[t] for t, w in a.items() if t in b), similarity.SCORE_DIGITS)


@pytest.fixture(scope="module", params=[(2, 90)])
def case(spark, request):
    rows = corpus(*request.param)
    docs = spark.createDataFrame(rows, "id bigint, text string")
    return rows, tfidf.fit(docs, "id", F.col("text"), TERMS)


@pytest.fixture(params=["postings", "one tile", "many tiles"])
def way(request, monkeypatch):
    """Both exact joins must give the same."""
    if request.param == "postings":
        monkeypatch.setattr(similarity, "DENSE_POSITIONS", 0)
    elif request.param == "many tiles":
        monkeypatch.setattr(tiles, "TILE_BYTES", 1)
        monkeypatch.setattr(tiles, "LEAST_ROWS", 7)
        monkeypatch.setattr(tiles, "TILES_PER_GROUP", 2)
    return request.param


def test_idf(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta")], "id bigint, text string")
    model = tfidf.fit(docs, "id", F.col("text"), tfidf.Vocabulary(max_features=9, stop_words=()))
    idf = {r.term: r.idf for r in model.terms.collect()}
    assert idf["alpha"] == pytest.approx(1.405465, abs=1e-6)
    assert idf["beta"] == pytest.approx(1.0)


def test_weights(case):
    rows, model = case
    expected = {(i, t): w for i, v in brute_vectors(rows, TERMS).items() for t, w in v.items()}
    found = {(r.id, r.term): r.weight for r in tfidf.weights(model).collect()}
    assert found.keys() == expected.keys()
    assert all(found[k] == pytest.approx(expected[k]) for k in found)


@pytest.mark.parametrize("threshold", [0.15, 0.6])
def test_similar_pairs(case, way, threshold):
    rows, model = case
    vectors = brute_vectors(rows, TERMS)
    groups = defaultdict(list)
    for i, v in vectors.items():
        groups[tuple(sorted((t, round(w, 12)) for t, w in v.items()))].append(i)
    heads = sorted(min(g) for g in groups.values())
    size = {min(g): len(g) for g in groups.values()}
    expected = {
        (a, b): (cosine(vectors[a], vectors[b]), size[a], size[b])
        for x, a in enumerate(heads) for b in heads[x + 1:]
        if cosine(vectors[a], vectors[b]) > threshold
    }
    pairs = similarity.similar_pairs(model.vectors, threshold)
    found = {(r.id_a, r.id_b): (r.score, r.copies_a, r.copies_b) for r in pairs.collect()}
    assert found.keys() == expected.keys()
    for key in found:
        assert found[key] == (pytest.approx(expected[key][0], abs=1e-7), *expected[key][1:])
    folded = similarity.fold_equal(model.vectors)
    ids = sorted(vectors)
    everything = sum(
        cosine(vectors[a], vectors[b]) > threshold for x, a in enumerate(ids) for b in ids[x + 1:]
    )
    assert similarity.pair_total(pairs, folded).first()["pairs"] == everything
    members = {r.id: r.rep for r in similarity.fold_members(model.vectors, folded).collect()}
    assert members == {i: min(g) for g in groups.values() for i in g}


def brute_nearest(vectors, n, threshold):
    out = {}
    for i, v in vectors.items():
        scored = [(cosine(v, o), j) for j, o in vectors.items() if j != i]
        best = sorted((s for s in scored if s[0] > threshold), key=lambda s: (-s[0], s[1]))[:n]
        for score, j in best:
            out[i, j] = score
    return out


@pytest.mark.parametrize("n, threshold", [(3, 0.15), (20, 0.15)])
def test_nearest(case, way, n, threshold):
    rows, model = case
    expected = brute_nearest(brute_vectors(rows, TERMS), n, threshold)
    found = {(r.src, r.dst): r.score for r in similarity.nearest(model.vectors, n, threshold).collect()}
    assert found.keys() == expected.keys()
    assert all(found[k] == pytest.approx(expected[k], abs=1e-7) for k in found)


def test_a_third_of_the_rows_are_copies(spark):
    """One group of copies: its members see each other first, and lists stay short."""
    rows = [(i, "same words here") for i in range(40)] + [(100 + i, f"same other{i % 7} text{i}") for i in range(80)]
    docs = spark.createDataFrame(rows, "id bigint, text string")
    terms = tfidf.Vocabulary(max_features=500, stop_words=())
    model = tfidf.fit(docs, "id", F.col("text"), terms)
    flat = [(i, t) for i, t in rows]
    vectors = {}
    for i, v in brute_vectors(flat, tfidf.Vocabulary(max_features=500, stop_words=())).items():
        vectors[i] = v
    found = similarity.nearest(model.vectors, 20, 0.15)
    assert found.groupBy("src").count().agg(F.max("count")).first()[0] <= 20
    first = {r.dst for r in found.filter("src = 39").collect()}
    assert first == set(range(20))


def test_twenty_of_equal_scores_by_key(spark):
    edges = spark.createDataFrame([("a", f"k{i:02d}", 0.5) for i in range(25)], "src string, dst string, score double")
    kept = similarity.similar_lists(edges)
    assert sorted(r.dst for r in kept.collect()) == [f"k{i:02d}" for i in range(20)]
    low = spark.createDataFrame([("a", "b", 0.15)], "src string, dst string, score double")
    assert similarity.similar_lists(low).count() == 0


def test_two_hop(spark):
    edges = [("a", "b", 0.5), ("a", "c", 0.4), ("b", "d", 0.5), ("c", "d", 0.5), ("b", "a", 0.5)]
    frame = spark.createDataFrame(edges, "src string, dst string, score double")
    hops = {(r.src, r.dst): r.score for r in similarity.two_hop(frame).collect()}
    assert hops["a", "d"] == pytest.approx(0.315)
    assert ("a", "a") not in hops
    frame = frame.unionByName(spark.createDataFrame([("a", "d", 0.2)], "src string, dst string, score double"))
    lists = {(r.src, r.dst): r.score for r in similarity.similar_lists(frame).collect()}
    assert lists["a", "d"] == 0.315


def test_score_is_at_most_one(spark):
    steps = [("a", f"m{i}", 0.9) for i in range(4)] + [(f"m{i}", "z", 0.9) for i in range(4)]
    frame = spark.createDataFrame(steps, "src string, dst string, score double")
    lists = {(r.src, r.dst): r.score for r in similarity.similar_lists(frame).collect()}
    assert lists["a", "z"] == 1.0
    packed = {r.src: [x.name for x in r.similar] for r in similarity.packed_lists(similarity.similar_lists(frame)).collect()}
    assert packed["a"] == ["z", "m0", "m1", "m2", "m3"]


def test_blend_is_the_weighted_sum(spark):
    rows = corpus(5, 30, copies=0.0)
    other = corpus(6, 30, copies=0.0)
    a = tfidf.fit(spark.createDataFrame(rows, "id bigint, text string"), "id", F.col("text"), TERMS)
    b = tfidf.fit(spark.createDataFrame(other, "id bigint, text string"), "id", F.col("text"), TERMS)
    va, vb = brute_vectors(rows, TERMS), brute_vectors(other, TERMS)
    both = {(r.src, r.dst): r.score for r in similarity.nearest(tfidf.blend(a, b, 0.55, 0.45), 29, 0.0).collect()}
    for (i, j), score in both.items():
        expected = 0.55 * cosine(va.get(i, {}), va.get(j, {})) + 0.45 * cosine(vb.get(i, {}), vb.get(j, {}))
        assert score == pytest.approx(expected, abs=1e-6)


def test_similarity_plans_have_no_nested_loops(case, spark):
    _, model = case
    folded = similarity.fold_equal(model.vectors)
    plan = similarity._candidates(similarity.postings(folded.drop("copies")), 0.5)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_cost_chooses_the_way(spark, case, monkeypatch):
    _, model = case
    folded = similarity.fold_equal(model.vectors)
    assert similarity._by_tiles(folded, 0.5)[0]
    monkeypatch.setattr(similarity, "TILE_SECONDS", 0.0)
    monkeypatch.setattr(similarity, "SECONDS_PER_MEETING", 0.0)
    assert not similarity._by_tiles(folded, 0.5)[0]
    monkeypatch.setattr(similarity, "SECONDS_PER_MEETING", 1.0)
    assert similarity._by_tiles(folded, 0.5)[0]


def families(seed, n):
    """Documents in families of near copies, over a wide vocabulary."""
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(4000)]
    rows = []
    while len(rows) < n:
        base = [rng.choice(words) for _ in range(60)]
        for _ in range(rng.choice([1, 1, 2, 4])):
            own = [rng.choice(words) if rng.random() < 0.06 else w for w in base]
            rows.append((len(rows), " ".join(own)))
    return rows[:n]


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_approximate_mode_finds_nearly_all_and_nothing_wrong(spark, threshold):
    docs = spark.createDataFrame(families(8, 900), "id bigint, text string")
    vectors = tfidf.fit(docs, "id", F.col("text"), tfidf.Vocabulary(max_features=4000, stop_words=())).vectors
    pairs = lambda df: {(r.id_a, r.id_b): r.score for r in df.collect()}
    exact = pairs(similarity.similar_pairs(vectors, threshold))
    found = pairs(similarity.similar_pairs(vectors, threshold, similarity.Approximate()))
    assert len(exact) > 200 and set(found) <= set(exact)
    assert all(found[k] == pytest.approx(exact[k], abs=1e-7) for k in found)
    assert len(found) >= 0.9 * len(exact)


def test_approximate_mode_does_not_multiply_a_hot_bucket(spark, monkeypatch):
    """Copies are one vector, and vectors that share every band meet in a grid."""
    rows = [(i, "same words here") for i in range(300)] + [(i, f"same words here also{i % 3}") for i in range(300, 330)]
    docs = spark.createDataFrame(rows, "id bigint, text string")
    vectors = tfidf.fit(docs, "id", F.col("text"), tfidf.Vocabulary(max_features=50, stop_words=())).vectors
    found = similarity.near_pairs(vectors, 0.3, similarity.Approximate(recall=0.99))
    exact = similarity.near_pairs(vectors, 0.3)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, exact.collect()))


def test_rows_that_meet_grow_with_the_documents(spark):
    met = {}
    for n in (400, 4000):
        docs = spark.createDataFrame(families(9, n), "id bigint, text string")
        vectors = tfidf.fit(docs, "id", F.col("text"), tfidf.Vocabulary(max_features=4000, stop_words=())).vectors
        met[n] = similarity.approximate_candidates(similarity.fold_equal(vectors), 0.8, similarity.Approximate()).count()
    assert met[4000] < 25 * met[400]  # all pairs would be 100 times as many


def test_band_keys_do_not_depend_on_how_many_bands_are_taken_at_a_time(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, idx := sorted(rng.sample(range(60), i % 7)), [1 / max(len(idx), 1) ** 0.5] * len(idx)) for i in range(80)]
    vectors = spark.createDataFrame(rows, "id long, idx array<int>, w array<double>").repartition(3, "id")
    found = []
    for size in (1, 50_000, 2 << 20):
        monkeypatch.setattr(similarity, "NORMAL_BYTES", size)
        found.append(sorted(map(tuple, similarity.band_keys(vectors, 12, 9, 3).collect())))
    assert found[0] == found[1] == found[2]
    assert len(found[0]) == 12 * sum(1 for _, idx, _ in rows if idx)
    # rows with the same positions, here a single one, share all bands; others do not
    own = defaultdict(set)
    for i, bucket in found[0]:
        own[i].add(bucket)
    same = [(a, b) for a, x, _ in rows for b, y, _ in rows if a < b and x and x == y]
    assert same and all(own[a] == own[b] for a, b in same)
    assert len({frozenset(v) for v in own.values()}) > 20


def test_bands_reach_the_wanted_chance():
    for rows, threshold in ((1000, 0.8), (10**6, 0.8), (1000, 0.25)):
        bands, bits = similarity.Approximate(0.95).sizes(rows, threshold)
        same = 1 - math.acos(threshold) / math.pi
        assert 1 - (1 - same**bits) ** bands >= 0.95 > 1 - (1 - same**bits) ** (bands - 1)


# Vocabularies


@pytest.mark.parametrize("terms", [
    tfidf.Vocabulary(ngrams=(1, 2), stop_words=()), tfidf.Vocabulary(min_df=2, stop_words=()),
    tfidf.Vocabulary(stop_words=(), max_df=0.5), tfidf.Vocabulary(max_features=5, stop_words=(), max_df=0.2),
])
@pytest.mark.parametrize("rows_per_task", [200_000, 5])
def test_vocabulary_without_a_cap(spark, monkeypatch, terms, rows_per_task):
    monkeypatch.setattr(tfidf, "ROWS_PER_TASK", rows_per_task)
    rows = corpus(3, 70)
    docs = spark.createDataFrame(rows, "id bigint, text string")
    model = tfidf.fit(docs, "id", F.col("text"), terms)
    df = defaultdict(set)
    for i, text in rows:
        tokens = text.split()
        for t in tokens + ([f"{a} {b}" for a, b in zip(tokens, tokens[1:])] if terms.ngrams[1] == 2 else []):
            df[t].add(i)
    total = {t: sum(text.split().count(t) for _, text in rows) for t in df}
    high = terms.max_df * len(rows) if terms.max_df else len(rows)
    kept = [t for t in df if terms.min_df <= len(df[t]) <= high]
    kept = sorted(sorted(kept, key=lambda t: (-total[t], t))[: terms.max_features], key=lambda t: (len(df[t]), t))
    found = model.terms.orderBy("idx").collect()
    assert [(r.idx, r.term, r.df) for r in found] == [(n, t, len(df[t])) for n, t in enumerate(kept)]
    idf = {t: math.log((1 + len(rows)) / (1 + len(df[t]))) + 1 for t in kept}
    weights = defaultdict(dict)
    for r in tfidf.weights(model).collect():
        weights[r.id][r.term] = r.weight
    for i, text in rows:
        tokens = text.split()
        grams = tokens + ([f"{a} {b}" for a, b in zip(tokens, tokens[1:])] if terms.ngrams[1] == 2 else [])
        raw = {t: grams.count(t) * idf[t] for t in set(grams) if t in idf}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        assert weights.get(i, {}) == pytest.approx({t: v / norm for t, v in raw.items()})


def test_no_task_numbers_an_uncapped_vocabulary(spark, case):
    rows, _ = case
    docs = spark.createDataFrame(rows, "id bigint, text string")
    model = tfidf.fit(docs, "id", F.col("text"), tfidf.Vocabulary(ngrams=(1, 2)))
    assert not model.bounded
    for frame in (tfidf.weights(model), tfidf.blend(model, model, 0.5, 0.5)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "SinglePartition" not in plan


def test_blend_of_uncapped_models_is_that_of_capped_ones(spark, case):
    rows, _ = case
    docs = spark.createDataFrame(rows, "id bigint, text string")
    blended = []
    for most in (None, 10_000):
        models = [tfidf.fit(docs, "id", F.col("text"), tfidf.Vocabulary(max_features=most, ngrams=n)) for n in ((1, 1), (2, 2))]
        blended.append({r.id: (r.idx, r.w) for r in tfidf.blend(*models, 0.6, 0.4).collect()})
    assert blended[0] == {i: (idx, pytest.approx(w)) for i, (idx, w) in blended[1].items()}


def counted(spark, tallies, parts):
    rows = [([{"term": t, "tf": n} for t, n in sorted(tally.items())],) for tally in tallies]
    return spark.createDataFrame(rows, "counts array<struct<term: string, tf: int>>").repartition(parts)


@pytest.mark.parametrize("seed, held, sent, proved", [(1, 64, 8, True), (2, 5, 4, True), (3, 1, 1, None)])
@pytest.mark.parametrize("min_df, max_df", [(1, float("inf")), (3, 60)])
def test_most_frequent_terms(spark, monkeypatch, seed, held, sent, proved, min_df, max_df):
    monkeypatch.setattr(heavy, "HELD", held)
    monkeypatch.setattr(heavy, "SENT", sent)
    rng = random.Random(seed)
    words = [f"t{i:03d}" for i in range(600)]
    tallies = []
    for _ in range(200):
        tally = defaultdict(int)
        for w in rng.choices(words, weights=[1 / (i + 1) for i in range(600)], k=30):
            tally[w] += 1
        tallies.append(tally)
    tallies[0]["once"] = 500  # often, in one document
    df, total = defaultdict(int), defaultdict(int)
    for tally in tallies:
        for t, n in tally.items():
            df[t] += 1
            total[t] += n
    wanted = sorted((t for t in df if min_df <= df[t] <= max_df), key=lambda t: (-total[t], t))[:20]
    found = heavy.most_frequent(counted(spark, tallies, 4), 20, min_df, max_df)
    if proved and max_df > len(tallies):  # else more may be left out than the margin holds
        assert found is not None
    if found is not None:
        assert [tuple(r) for r in found.orderBy(F.desc("occurrences"), "term").collect()] == [(t, df[t], total[t]) for t in wanted]
    sent_terms = heavy.summaries(counted(spark, tallies, 4), 20).count()
    assert sent_terms <= 4 * (20 * sent + 1)


def test_most_frequent_of_few_terms(spark):
    found = heavy.most_frequent(counted(spark, [{"a": 2, "b": 1}, {"b": 1}, {}], 2), 10)
    assert sorted(map(tuple, found.collect())) == [("a", 1, 2), ("b", 2, 2)]
    assert heavy.most_frequent(counted(spark, [{}], 1), 10).count() == 0


def test_pairs_of_distinct_vectors_take_no_join_by_shuffle(case, monkeypatch):
    monkeypatch.setattr(tiles, "TILE_BYTES", 1)
    pairs = similarity.similar_pairs(case[1].vectors, 0.15)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1 and "Join" not in plan  # the deal of tiles to cells


@pytest.mark.parametrize("most", [None, 5])
def test_a_fit_leaves_its_vectors_and_terms_alone(spark, most):
    docs = spark.createDataFrame([(1, "ab cd ab"), (2, "cd ef"), (3, None)], "id bigint, text string")
    terms = tfidf.Vocabulary(max_features=most, stop_words=())
    with session.staging(spark):
        with session.passing(spark):
            session.stage(docs, "gone")
        model = tfidf.fit(docs, "id", F.col("text"), terms, "left-alone")
        left = {p for paths in session._watched for p in paths if Path(p).exists()}
        assert left == {model.vectors.staged_path, model.terms.staged_path}
        assert {r.term for r in tfidf.weights(model).collect()} == {"ab", "cd", "ef"}


def tile_vectors(spark, rows=300, positions=60):
    """Vectors of some common and many rare positions, and their products by brute force."""
    rng = np.random.default_rng(7)
    x = rng.random((rows, positions)) * (rng.random((rows, positions)) < np.linspace(0.01, 0.9, positions))
    x[:, 0] += 1e-3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    listed = [(i, [int(p) for p in np.flatnonzero(v)], [float(w) for w in v[v > 0]]) for i, v in enumerate(x)]
    return spark.createDataFrame(listed, "id bigint, idx array<int>, w array<double>").repartition(4), x @ x.T


@pytest.mark.parametrize("share", [0.0, 0.005, 0.2, 2.0])
def test_best_of_rows_by_positions_written_out_and_single_entries(spark, monkeypatch, share):
    monkeypatch.setattr(tiles, "BEST_ROWS", 40)
    monkeypatch.setattr(tiles, "DENSE_SHARE", share)
    monkeypatch.setattr(tiles, "ENTRIES", 50)
    vectors, products = tile_vectors(spark)
    np.fill_diagonal(products, -1)
    found = tiles.pairs_above(vectors, 60, 300, 0.15, 5).collect()
    assert len({(r.l_id, r.r_id) for r in found}) == len(found)
    assert all(r.dot == pytest.approx(products[r.l_id, r.r_id], abs=1e-12) for r in found)
    for i, row in enumerate(products):
        best = {int(j) for j in np.argsort(-row)[:5] if row[j] > 0.15}
        assert best <= {r.r_id for r in found if r.l_id == i}


def test_the_best_of_its_own_tile_travel_with_a_row(spark, monkeypatch):
    monkeypatch.setattr(tiles, "BEST_ROWS", 40)
    vectors, products = tile_vectors(spark)
    np.fill_diagonal(products, -1)
    packed, count = tiles._packed(vectors, 60, 300, None, 5)
    assert count >= 300 // 40
    for tile in packed.collect():
        low = np.frombuffer(tile.low).reshape(-1, 5)
        for i, best in zip(tile.ids, low):
            assert best == pytest.approx(np.sort(products[i][tile.ids])[-5:], abs=1e-12) or len(tile.ids) <= 5


def test_every_cell_has_a_partition_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(tiles, "BEST_ROWS", 20)
    packed, count = tiles._packed(tile_vectors(spark)[0], 60, 300, None, 5)
    dealt = tiles._cells(packed, count).select("cell", F.spark_partition_id().alias("part")).distinct().collect()
    cells = {r.cell for r in dealt}
    assert len(cells) > 1 and cells == set(range(len(cells)))
    assert len(dealt) == len({r.part for r in dealt}) == len(cells)


def test_rows_that_meet_are_counted_in_place(case):
    _, model = case
    least = 0.3 * similarity.DEPTH
    expected = similarity.postings(model.vectors).filter(F.col("reach") > least).groupBy("idx").count()
    assert sorted(similarity._joined_rows(model.vectors, 500, least).collect()) == sorted(expected.collect())


def test_digests_are_equal_for_equal_vectors_only(spark):
    rows = [(1, [0, 2], [0.5, 0.25]), (2, [0, 2], [0.5, 0.25]), (3, [0, 2], [0.25, 0.5]), (4, [0], [0.5]), (5, [], [])]
    frame = spark.createDataFrame(rows, "id bigint, idx array<int>, w array<double>")
    found = {r.id: bytes(r.digest) for r in frame.select("id", similarity._digest().alias("digest")).collect()}
    assert found[1] == found[2] and len(set(found.values())) == 4
    members = similarity.fold_members(frame, similarity.fold_equal(frame))
    assert sorted(map(tuple, members.collect())) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)]


@pytest.mark.parametrize("share", [0.0, 2.0])
def test_a_position_that_comes_twice_in_a_row_counts_once(monkeypatch, share):
    monkeypatch.setattr(tiles, "DENSE_SHARE", share)
    opened, scores_of = tiles._products(4)
    entries = [[(1, 0.25), (1, 0.5), (3, 0.5)], [(1, 0.5)], [(0, 1.0), (3, 0.125), (3, 0.25)], []]
    tile = opened({
        "sizes": np.array([len(row) for row in entries], np.int32),
        "at": np.array([p for row in entries for p, _ in row], np.int32),
        "w": np.array([w for row in entries for _, w in row]),
    })
    written = np.array([[dict(row).get(p, 0.0) for p in range(4)] for row in entries])
    assert scores_of(tile, tile).tolist() == (written @ written.T).tolist()


@pytest.mark.parametrize("gather", [0, 10**9])
@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_a_bound_from_the_head_leaves_all_pairs(spark, monkeypatch, threshold, gather):
    """Positions beyond the head count, and rows are written out only where the bound allows a pair."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(240):
        if i % 3 and rows:
            at, w = (list(x) for x in rows[int(rng.integers(len(rows)))][1:])
            w[int(rng.integers(len(w)))] *= 1.7
        else:
            at = sorted(rng.choice(60, 12, replace=False).tolist())
            w = (rng.random(12) * np.where(np.array(at) < 40, 0.6, 1.0)).tolist()
        length = math.sqrt(sum(x * x for x in w))
        rows.append((i, at, [x / length for x in w]))
    for name, value in (("TILE_BYTES", 1), ("LEAST_ROWS", 17), ("HEAD", 20), ("GATHER", gather)):
        monkeypatch.setattr(tiles, name, value)
    vectors = spark.createDataFrame(rows, "id long, idx array<int>, w array<double>")
    x = np.zeros((len(rows), 60))
    for i, at, w in rows:
        x[i, at] = w
    head = tiles._head(vectors, 60, len(rows), threshold)
    assert set(head.tolist()) == set(np.argsort(-(x**2).sum(0))[:20].tolist())
    assert tiles._head(vectors, 60, len(rows), 0.01) is None  # what the head leaves is too much
    found = {(min(r[:2]), max(r[:2])): r["dot"] for r in tiles.pairs_above(vectors, 60, len(rows), threshold).collect()}
    scores = x @ x.T
    expected = {(int(a), int(b)) for a, b in np.argwhere(np.triu(scores > threshold, 1))}
    assert {pair for pair, dot in found.items() if dot > threshold} == expected and len(expected) > 100
    assert all(found[pair] == pytest.approx(scores[pair], abs=1e-12) for pair in found)


@pytest.mark.parametrize("threshold, bits", [(0.6, None), (0.8, 6), (0.95, 34)])
def test_candidates_of_bands_meet_in_tiles(spark, monkeypatch, threshold, bits):
    mode = similarity.Approximate(bits=bits)
    texts = families(12, 200)
    again = [(i, texts[i + 1][1]) for i in range(0, 60, 3)] + [(i, texts[i][1]) for i in range(80, 90)] + [(None, texts[7][1])]
    docs = spark.createDataFrame(texts + again + [(900, ""), (901, "v1 v2"), (902, "v1 v2"), (903, "v1 v2 v1")], "id bigint, text string")
    vectors = tfidf.fit(docs, "id", F.col("text"), tfidf.Vocabulary(max_features=4000, stop_words=())).vectors
    vectors = vectors.unionByName(spark.createDataFrame([(950, [], [])], vectors.schema))
    for name, value in (("TILE_BYTES", 1), ("LEAST_ROWS", 23), ("TILES_PER_GROUP", 2)):
        monkeypatch.setattr(tiles, name, value)
    pairs = similarity.similar_pairs(vectors, threshold, mode)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1 and "Join" not in plan  # no candidate is shuffled
    found = sorted(map(tuple, pairs.collect()))
    monkeypatch.setattr(similarity, "DENSE_POSITIONS", 0)
    expected = sorted(map(tuple, similarity.similar_pairs(vectors, threshold, mode).collect()))
    assert [r[:2] + r[3:] for r in found] == [r[:2] + r[3:] for r in expected] and found
    assert [r[2] for r in found] == pytest.approx([r[2] for r in expected], abs=1e-7)
