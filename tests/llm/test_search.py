"""Hard negatives, ranked search and packing against brute force."""

import functools
import math
import random
import re
import zlib

import numpy as np
import pytest
import tokenizers
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from shelfmark.llm import hard_negatives, lexical_search, packing, queries
from tests.llm import data

# Hard negatives


@given(st.integers(1, 70), st.integers(1, 70), st.integers(1, 70), st.integers(0, 2**31))
@settings(max_examples=40, deadline=None)
def test_strassen_is_the_product(m, k, n, seed):
    r = np.random.default_rng(seed)
    a, b = r.integers(-(2**40), 2**40, (m, k)), r.integers(-(2**40), 2**40, (k, n))
    exact = a.astype(object) @ b.astype(object)
    wrapped = [[(int(x) + 2**63) % 2**64 - 2**63 for x in row] for row in exact]
    assert hard_negatives.strassen(a, b).tolist() == wrapped


@given(st.lists(st.lists(st.tuples(st.integers(0, 4), st.integers(-2, 2)), max_size=12), max_size=5), st.integers(1, 4))
@settings(max_examples=60, deadline=None)
def test_heaps_keep_the_best(tiles, most):
    heaps, every = hard_negatives.Heaps(5, most), [[] for _ in range(5)]
    for n, tile in enumerate(tiles):
        ids = np.arange(len(tile)) * 10 + n
        scores = np.array([[s * (row + 1) for _, s in tile] for row in range(5)], np.int64).reshape(5, len(tile))
        allowed = np.array([[row != left_out for left_out, _ in tile] for row in range(5)], bool).reshape(5, len(tile))
        heaps.offer(scores, allowed, np.zeros(len(tile), np.int64), ids)
        for row in range(5):
            every[row] += [(-s, 0, i) for s, i, ok in zip(scores[row].tolist(), ids.tolist(), allowed[row]) if ok]
    found = dict(heaps.lists())
    for row in range(5):
        assert [(~e["inverse"], e["none"], e["id"]) for e in found.get(row, [])] == [(-s, n, i) for s, n, i in sorted(every[row])[:most]]


def plain_negatives(rows, positives=5, negatives=3):
    clean = set()
    for vec_id, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        clean.add((vec_id, label, tuple(math.floor(256 * x) for x in v)))
    last = lambda i: (i is None, i or 0)
    out = []
    for a in clean:
        if a[0] is None or a[0] % 50:
            continue
        score = lambda c: sum(x * y for x, y in zip(a[2], c[2]))  # noqa: B023, E731
        order = sorted((c for c in clean if c != a), key=lambda c: (-score(c), last(c[0])))
        for p in [c for c in order if c[1] == a[1]][:positives]:
            inside = [c for c in order if c[1] != a[1] and 50 * score(p) <= 100 * score(c) <= 95 * score(p)]
            out += [(a[0], p[0], n + 1, c[0], score(p), score(c)) for n, c in enumerate(inside[:negatives])]
    return out


def vectors(seed, n, dims, labels):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0.3, 0.5) for _ in range(dims)], r.choice(labels)) for i in range(n)]
    rows += [rows[50], rows[50], rows[3], (50, [0.5] * dims, 1), (100, rows[0][1], 1), (None, [0.4] * dims, 1), (None, [0.4] * dims, 2)]
    rows += [(n + i, rows[50][1], i % 3) for i in range(30)]  # ties
    rows += [(2000, None, 1), (2050, [1.0], None), (2100, [float("nan")] * dims, 1), (2150, [None] * dims, 1),
             (2200, [float("-inf")] + [0.0] * (dims - 1), 1), (2250, [], 1), (2300, [0.7], 2), (2350, [-1.0] * dims, 1)]
    return rows


def mined(spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("family", F.lit(1))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return [tuple(r) for r in hard_negatives.mine(table.repartition(3), F.col("id") % 50 == 0, label).collect()]



@pytest.mark.parametrize("bytes_each", [None, 1])
def test_negatives_equal_brute_force(spark, monkeypatch, bytes_each):
    if bytes_each is not None:  # tiles of the least size: many of one label, labels that share one
        monkeypatch.setattr(hard_negatives, "CANDIDATE_BYTES", bytes_each)
        monkeypatch.setattr(hard_negatives, "ANCHOR_BYTES", bytes_each)
    rows = vectors(5, 400, 6, [0, 0, 0, 1, 2, 3, 9])
    key = lambda row: tuple((v is None, v or 0) for v in row)
    found = mined(spark, rows)
    assert len(found) > 100 and sorted(found, key=key) == sorted(plain_negatives(rows), key=key)


def test_anchors_without_others(spark):
    assert mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(50, [1.0], 1), (51, [1.0], 1), (52, [0.1], 1)]) == []
    assert mined(spark, [(50, [0.0], 1), (51, [0.0], 1), (52, [0.0], 2)]) == [(50, 51, 1, 52, 0, 0)]


# Ranked search


def plain_search(docs, items, most=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    texts = [(i, w) for i, t in docs if (w := words(t))]
    total, every = len(texts), sum(len(w) for _, w in texts)
    asked = {}
    for item, t in items:
        asked.setdefault(item, set()).update(words(t))
    out = []
    for item, terms in asked.items():
        scored = []
        weights = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * sum(t in w for _, w in texts) + 1))) for t in terms}
        for i, w in texts:
            m = 10 + 90 * len(w) * total // every
            score = sum(weights[t] * (1000000000 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in terms if t in w)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(sorted(scored)[:most])]
    return out


def texts(seed, n):
    r = random.Random(seed)
    vocabulary = ["the", "of", "and"] + [f"w{i}" for i in range(60)] + ["Été", "été", "K", "x-y"]
    weights = [300, 200, 100] + [60 // (i + 1) + 1 for i in range(60)] + [3, 3, 3, 3]
    rows = [(i, " ".join(r.choices(vocabulary, weights, k=r.randint(1, 30)))) for i in range(n)]
    r.shuffle(rows)
    return rows + [(7, "the w59"), (7, "the w59"), (None, "w58 of w57"), (None, "w58 of w57"), (n, None), (n + 1, ""), (n + 2, "-- !"), (n + 3, data.LONG)]


ITEMS = [(1, "the w59 of w58"), (2, "w3 W40 w41,the THE"), (3, None), (4, ""), (5, "unseen words"), (None, "w5 of"), (6, "été É"),
         (2, "w22"), (7, "the of and"), (8, " ".join(f"w{i}" for i in range(60))), (8, "the"), (9, "K x y")]


@pytest.mark.parametrize("piece, step, block", [(8192, 512, 1 << 25), (100, 3, 1 << 25), (37, 1, 40)])
def test_search_equals_brute_force(spark, monkeypatch, piece, step, block):
    for name, value in (("PIECE", piece), ("STEP", step), ("BLOCK_BYTES", block)):
        monkeypatch.setattr(lexical_search, name, value)
    docs = texts(3, 600)
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit(1)).coalesce(2)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("score", F.lit("x"))
    key = lambda row: tuple((v is None, v or 0) for v in row)
    found = [tuple(r) for r in lexical_search.top_documents(table, items).collect()]
    assert sorted(found, key=key) == sorted(plain_search(docs, ITEMS), key=key)


@given(st.integers(0, 2**31), st.integers(1, 12), st.integers(1, 200))
@settings(max_examples=60, deadline=None)
def test_hybrid_finds_the_best(seed, lists, documents):
    import pyarrow as pa

    r = random.Random(seed)
    pairs, totals = [], [0] * documents
    for _ in range(lists):
        docs = sorted(r.sample(range(documents), r.randint(1, documents)))
        scores = [r.randint(1, 6) for _ in docs]
        pairs.append((np.array(docs), np.array(scores)))
        for d, s in zip(docs, scores):
            totals[d] += s
    best = lexical_search.Best(4)
    best.ids = pa.array(range(documents))
    lexical_search.hybrid(pairs, documents, best)
    wanted = sorted((-s, d) for d, s in enumerate(totals) if s)[:4]
    assert [(s, d) for s, _, d in best.kept] == wanted


def test_search_skips(monkeypatch):
    """Documents of a list that cannot reach the best are not offered."""
    import pyarrow as pa

    offered = []

    class Seen(lexical_search.Best):
        def offer(self, found, total):
            offered.extend(found.tolist())
            super().offer(found, total)

    monkeypatch.setattr(lexical_search, "STEP", 8)
    best = Seen(2)
    best.ids = pa.array(range(4000))
    common = (np.arange(4000), np.ones(4000, np.int64))
    lexical_search.search([common, (np.array([1, 2, 3999]), np.array([50, 60, 55]))], best)
    assert [(-s, d) for s, _, d in best.kept] == [(61, 2), (56, 3999)] and len(offered) < 50


def test_search_with_names(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), ("c", "three")], "doc_id string, text string")
    items = spark.createDataFrame([("i", "one")], "item_id string, text string")
    found = sorted(tuple(r)[:3] for r in lexical_search.top_documents(docs, items).collect())
    assert found == [("i", 1, "a"), ("i", 2, "b")]


# Packing

library_of = functools.lru_cache(tokenizers.Tokenizer.from_file)


@given(st.lists(st.integers(1, 400), max_size=60), st.sampled_from([1, 7, 16, 100, 128]))
@settings(max_examples=80, deadline=None)
def test_every_token_is_packed_once_without_padding(lengths, capacity):
    seen = {}
    for pieces in packing.pack(lengths, capacity):
        size = sum(p[0] for p in pieces)
        assert size == capacity or (0 < size < capacity and size & (size - 1) == 0)
        for n, doc, start in pieces:
            for at in range(start, start + n):
                assert seen.setdefault((doc, at), 1) and n > 0
    assert sum(p[0] for s in packing.pack(lengths, capacity) for p in s) == sum(lengths) == len(seen)


@given(st.lists(st.integers(1, 50), max_size=60))
@settings(max_examples=80, deadline=None)
def test_the_tree_finds_the_first_bin(sizes):
    room, wanted = [], []
    tree = packing.Tournament(50, len(sizes))
    for size in sizes:
        at = next((i for i, left in enumerate(room) if left >= size), len(room))
        if at == len(room):
            room.append(50)
        room[at] -= size
        wanted.append(at)
    assert [packing.Tournament.first(tree, size) for size in sizes] == wanted


@given(st.text(st.sampled_from("aB é'sţ́\u0344 \t\n\r\u2028\x1c\u00a0<|endoftext|>漢1２!"), max_size=60))
@settings(max_examples=200, deadline=None)
def test_ids_are_those_of_the_library(text):
    path = queries.tokenizer("word_bpe_49k.json")
    library = library_of(path)
    with open(path, encoding="utf-8") as file:
        assert packing._tokenizer(file.read()).of(text, 2).tolist() == library.encode(text, add_special_tokens=False).ids + [2]


def test_small_words_skip_the_steps_before_the_model():
    with open(queries.tokenizer("word_bpe_49k.json"), encoding="utf-8") as file:
        ids = packing._Ids(file.read())
    library, asked = ids.library, []

    class Counted:
        def encode(self, text, **options):
            asked.append(text)
            return library.encode(text, **options)

    ids.library = Counted()
    text = "straße entionedé Größe, naïve. ÿþ don't x² ﬁn"
    wanted = library.encode(text, add_special_tokens=False).ids + [2]
    assert ids.of(text, 2).tolist() == wanted
    assert not set(asked) & {"straße", "entionedé", "naïve", "ÿþ"} and {"don't", "x²", "ﬁn"} <= set(asked)


def test_other_vocabularies_are_refused():
    with open(queries.tokenizer("byte_bpe_50k.json"), encoding="utf-8") as file, pytest.raises(ValueError):
        packing._Ids(file.read())


def test_packed_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    path = queries.tokenizer("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    docs = data.frame(spark).withColumn("length", F.lit("x")).withColumn("ids", F.lit(1))
    pieces = packing.packed(docs, path, group_tokens=20_000).withColumn("ids_crc32", F.crc32("ids")).collect()
    assert sorted({p["doc_id"] for p in pieces}, key=str) == sorted({r[0] for r in data.rows()}, key=str)

    # pieces of one document in the order of their starts give its ids
    by_id = {}
    for p in sorted(pieces, key=lambda p: p["start"]):
        assert p["ids_crc32"] == zlib.crc32(p["ids"]) and len(p["ids"]) == 4 * p["length"]
        by_id.setdefault(p["doc_id"], []).append(p)
    for doc_id, text, *_ in data.rows():
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        own = by_id[doc_id]
        if doc_id not in (None, 7):  # these ids repeat
            assert np.frombuffer(b"".join(p["ids"] for p in own), "<u4").tolist() == ids
            assert {p["doc_tokens"] for p in own} == {len(ids)}
    total = sum(len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in data.rows())
    assert sum(p["length"] for p in pieces) == total

    # sequences have no gaps and no padding
    sequences = {}
    for p in sorted(pieces, key=lambda p: p["offset"]):
        assert p["offset"] == sequences.get(p["sequence_id"], 0)
        sequences[p["sequence_id"]] = p["offset"] + p["length"]
    assert all(n <= 4096 and n & (n - 1) == 0 for n in sequences.values())


def test_groups_are_independent_of_the_input_order(spark):
    path = queries.tokenizer("word_bpe_49k.json")
    docs = data.frame(spark)
    one = packing.packed(docs.repartition(5), path).drop("sequence_id").collect()
    two = packing.packed(docs.orderBy(F.desc("text")).coalesce(1), path).drop("sequence_id").collect()
    assert sorted(map(str, one)) == sorted(map(str, two))


def test_contract_of_packing(spark, sf_dir):
    found = queries.QUERIES["op13_pack_sequences"](spark, sf_dir)
    assert found.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"),
                            ("doc_tokens", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    library = tokenizers.Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    texts_of = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t in texts_of.items()}
    covered = dict.fromkeys(ids, 0)
    for r in sorted(found.collect(), key=lambda r: r["start"]):
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == covered[r["doc_id"]] and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        covered[r["doc_id"]] += r["length"]
    assert covered == {i: len(x) for i, x in ids.items()}
