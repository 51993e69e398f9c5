"""Operators that shuffle, against brute force on small tables."""

import collections
import hashlib
import random
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from shelfmark.llm import line_dedup, mixing, ngram_join
from tests.llm import data

SPACE = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def docs(spark):
    return data.frame(spark).cache()


def same(found, wanted):
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted(map(tuple, found), key=key) == sorted(wanted, key=key)


# Lines


def line_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def plain_dedup(rows, threshold):
    counts = collections.Counter(k for _, t, *_ in rows for k in {line_key(x) for x in (t or "").split("\n")} if k)
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if counts[line_key(x)] < threshold or not line_key(x)]
        out.append((doc_id, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def line_rows(seed, n):
    r = random.Random(seed)
    lines = ["", " ", "A", "a ", "\tB", "b", "É", "é", "long line of its own", "c\r"]
    out = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(0, 6))), "en", "s", 0) for i in range(n)]
    return [*out, (None, None, None, None, None), (0, "A\nunlike", "x", "y", 1)]


@pytest.mark.parametrize("threshold", [2, 10])
def test_lines(spark, threshold):
    rows = line_rows(1, 40)
    table = data.frame(spark, rows).withColumn("N_LINES", F.lit(1)).withColumn("digest", F.lit(2))
    found = line_dedup.dedup(table, threshold=threshold)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "digest", "n_lines", "n_dropped"]
    same(found.select("doc_id", "text", "n_lines", "n_dropped").collect(), plain_dedup(rows, threshold))


def test_lines_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = line_rows(2, 30)
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", 0)
    found = line_dedup.dedup(data.frame(spark, rows), threshold=3)
    same(found.select("doc_id", "text", "n_lines", "n_dropped").collect(), plain_dedup(rows, 3))


@pytest.mark.parametrize("shards", [1, 4])
def test_insert_and_delete_are_reversible(spark, shards):
    first, second = line_rows(3, 30), line_rows(4, 30)
    a, b = data.frame(spark, first), data.frame(spark, second)
    counts = line_dedup.reference_counts(a).cache()
    filters = line_dedup.build_filters(counts, 3, shards).cache()
    both = line_dedup.insert(counts, b).cache()
    filters_both = line_dedup.update_filters(filters, counts, both, 3).cache()
    found = line_dedup.drop_lines(a.union(b), both, filters_both, threshold=3)
    same(found.select("doc_id", "text", "n_lines", "n_dropped").collect(), plain_dedup(first + second, 3))
    back = line_dedup.delete(both, b).cache()
    same(back.collect(), [tuple(r) for r in counts.collect()])
    filters_back = line_dedup.update_filters(filters_both, both, back, 3)
    found = line_dedup.drop_lines(a, back, filters_back, threshold=3)
    same(found.select("doc_id", "text", "n_lines", "n_dropped").collect(), plain_dedup(first, 3))


@pytest.mark.parametrize("limit", [0, 1 << 26])
def test_a_state_that_lost_documents_and_got_them_back(spark, monkeypatch, limit):
    """The way of the query; the changed rows bring lines below the threshold and above it again."""
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", limit)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 3)
    rows = line_rows(6, 60)
    docs = data.frame(spark, rows)
    found = line_dedup.dedup_with_changes(docs, docs.filter("doc_id % 3 = 0"), threshold=8)
    same(found.select("doc_id", "text", "n_lines", "n_dropped").collect(), plain_dedup(rows, 8))


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 400), st.integers(0, 10**6))
def test_cuckoo_filter(n, seed):
    digests = [hashlib.md5(f"{seed}-{i}".encode()).digest() for i in range(n)]
    made = line_dedup.Cuckoo.sized(n)
    assert made.insert(digests)
    made = line_dedup.Cuckoo.loaded(made.saved())
    assert made.may_hold(digests).all()
    half = n // 2
    made.delete(digests[:half])
    assert made.may_hold(digests[half:]).all()
    made.delete(digests[half:])
    assert not made.table.any()


def test_full_shard_passes_everything(spark, monkeypatch):
    rows = line_rows(5, 30)
    table = data.frame(spark, rows)
    counts = line_dedup.reference_counts(table).cache()
    heavy = line_dedup.build_filters(counts, 3).withColumn("filter", F.lit(None).cast("binary"))
    found = line_dedup.drop_lines(table, counts, heavy, threshold=3)
    same(found.select("doc_id", "text", "n_lines", "n_dropped").collect(), plain_dedup(rows, 3))


# N-gram join


def plain_components(rows, words_each, a, b):
    sets = []
    for _, text, *_ in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        n = max(len(w) - words_each + 1, 1) if w else 0
        sets.append({tuple(w[i : i + words_each]) for i in range(n)})
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and b * len(x & y) >= a * len(x | y):
                group[top(i)] = top(j)
    least = {}
    for i, row in enumerate(rows):
        known = [v for v in (least.get(top(i)), row[0]) if v is not None]
        least[top(i)] = min(known, default=None)
    return [(row[0], len(s), least[top(i)] if s else row[0]) for i, (row, s) in enumerate(zip(rows, sets))]


def families(seed, groups, sizes):
    """Groups of texts a few words apart, with passages that many groups share."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [r.choice(vocabulary) for _ in range(40)]
    rows = []
    for _ in range(groups):
        words = [r.choice(vocabulary) for _ in range(r.choice(sizes))]
        if r.random() < 0.4:
            words[len(words) // 2 : len(words) // 2] = passage
        for _ in range(r.choice([1, 1, 2, 3, 9])):
            changed = list(words)
            for _ in range(r.randint(0, 3)):
                changed[r.randrange(len(changed))] = r.choice(vocabulary)
            if r.random() < 0.3:
                changed = changed[r.randint(0, 2) :]
            rows.append((len(rows) * 7 % 1009, " ".join(changed), "en", "s", 0))
    return rows


@pytest.mark.parametrize("seed, sizes, words_each, threshold", [
    (1, [2, 5, 9, 14, 20, 26], 4, (85, 100)), (2, [30, 45, 60, 150], 4, (85, 100)), (3, [8, 20, 40, 90], 5, (80, 100)),
    (4, [6, 12, 18, 30], 1, (1, 2)), (5, [10, 40], 3, (1, 1)),
])
def test_components(spark, seed, sizes, words_each, threshold):
    rows = families(seed, 25, sizes)
    found = ngram_join.linked(data.frame(spark, rows), words_each=words_each, threshold=threshold)
    same(found.collect(), plain_components(rows, words_each, *threshold))


def test_components_of_odd_rows(docs):
    found = ngram_join.linked(docs.withColumn("node", F.lit(1)), words_each=4, threshold=(85, 100))
    same(found.collect(), plain_components(data.rows(), 4, 85, 100))


def plain_one_of_each(rows, words_each, a, b):
    """Components of whole rows by brute force; of each the row with the smallest id, set and text."""
    shingled = []
    for row in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in row[1] or "")) if w]
        size = min(words_each, len(words))
        shingled.append(frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else frozenset())
    group = list(range(len(rows)))

    def head(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, one in enumerate(shingled):
        for j in range(i):
            both = len(one & shingled[j])
            if one and shingled[j] and b * both >= a * (len(one) + len(shingled[j]) - both):
                group[head(i)] = head(j)
    kept = []
    for root in {head(i) for i, s in enumerate(shingled) if s}:
        own = [i for i, s in enumerate(shingled) if s and head(i) == root]
        least = min((rows[i][0] is None, rows[i][0] or 0) for i in own)
        candidates = [i for i in own if (rows[i][0] is None, rows[i][0] or 0) == least]
        kept.append((rows[candidates[0]][0], frozenset(shingled[i] for i in candidates), root))
    bare = {(rows[i][0], rows[i][1] or "") for i, s in enumerate(shingled) if not s}
    return kept, bare, shingled


def check_one_of_each(spark, rows):
    kept, bare, shingled = plain_one_of_each(rows, 5, 80, 100)
    found = [tuple(r) for r in ngram_join.one_of_each(data.frame(spark, rows)).collect()]
    set_of = {(r[0], r[1]): s for r, s in zip(rows, shingled)}
    with_words = [r for r in found if set_of[r[0], r[1]]]
    assert sorted(str(r[0]) for r in with_words) == sorted(str(i) for i, _, _ in kept)
    for row in with_words:
        assert any(row[0] == i and set_of[row[0], row[1]] in sets for i, sets, _ in kept)
    assert len({set_of[r[0], r[1]] for r in with_words}) == len(with_words)
    assert sorted(((r[0], r[1] or "") for r in found if not set_of[r[0], r[1]]), key=str) == sorted(bare, key=str)
    return found


def test_one_of_each(spark, docs):
    found = check_one_of_each(spark, data.rows())
    assert all(any(tuple(r) == f for r in map(tuple, data.rows())) for f in found)
    assert ngram_join.one_of_each(docs).columns == docs.columns


def test_one_of_each_of_repeated_and_null_ids(spark):
    """Near copies that share an id, or have none, are told apart by their sets."""
    base, other = data.prose(21, 90), data.prose(22, 90)
    near = lambda text, n: " ".join("changed" if i == n else w for i, w in enumerate(text.split()))
    rows = [
        (3, base), (5, near(base, 40)), (5, other), (7, near(other, 10)), (None, near(other, 70)), (None, near(base, 80)),
        (None, data.prose(23, 60)), (None, data.prose(23, 60)), (8, data.prose(24, 60)), (8, data.prose(24, 60).upper()),
        (8, data.prose(25, 60)), (9, ""), (9, ""), (9, None), (9, " "), (None, ""), (None, None), (10, "solo"),
    ]
    found = check_one_of_each(spark, [(i, t, "en", "s", 1) for i, t in rows])
    assert (5, near(base, 40), "en", "s", 1) not in found and (5, other, "en", "s", 1) in found


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(1, 60), st.sampled_from([(85, 100), (80, 100), (1, 2), (1, 1)]))
def test_threshold_numbers(n, m, threshold):
    t = ngram_join.Threshold(*threshold)
    a, b = threshold
    most = min(n, m)
    shared = next((o for o in range(most + 1) if b * o >= a * (n + m - o)), None)
    assert (shared is not None) == (m in t.partners(n))
    if shared is not None:
        assert shared == t.overlap(n, m) >= t.least(max(n, m))
        assert t.first(n) >= n - shared + t.slack(n) or t.first(n) == n


def test_boundary_follows_cost():
    t = ngram_join.Threshold(85, 100)
    assert ngram_join.boundary({}, t) == 0
    limit = ngram_join.boundary({n: 100 for n in range(1, 37)}, t)
    assert 4 <= limit < 30


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 400), (7, 7)]
    found = ngram_join.components(spark.createDataFrame(edges, "a long, b long"))
    same(found.collect(), [(i, 0) for i in range(201)] + [(500, 400), (400, 400)])


# Mixing


def fill(children, budget):
    """Budgets by trying: fill what reaches its capacity, share the rest exactly."""
    left, open_children, out = budget, dict(children), {}
    while open_children:
        weights = sum(w for _, w in open_children.values())
        full = [k for k, (c, w) in open_children.items() if c * weights <= w * left]
        if not full:
            break
        for k in full:
            out[k] = open_children[k][0]
        left -= sum(open_children.pop(k)[0] for k in full)
    weights = sum(w for _, w in open_children.values())
    return out | {k: (left * w / weights if weights else 0) for k, (c, w) in open_children.items()}


@pytest.mark.parametrize("total", [0, 10, 97, 400, 5000])
def test_budgets(spark, total):
    leaves = {("=a", "=x"): 100, ("=a", "=y"): 7, ("=a", ""): 30, ("=b", "=x"): 20, ("=b", "=z"): 0, ("=c", "=x"): 200}
    table = spark.createDataFrame([(*k, n) for k, n in leaves.items()], "p string, q string, tokens long")
    weights = {"p": {"a": 3, "b": 2}, "q": {"x": 2, None: 5}}
    found = {(r["p"], r["q"]): r["budget"] for r in mixing.budgets(table, ["p", "q"], weights, total, 2).collect()}
    tops = {p: (sum(2 * n for k, n in leaves.items() if k[0] == p), {"=a": 3, "=b": 2}.get(p, 1)) for p in ("=a", "=b", "=c")}
    given = fill(tops, total)
    assert sum(found.values()) == min(total, sum(2 * n for n in leaves.values()))
    for p in tops:
        own = {k: (2 * n, {"=x": 2, "": 5}.get(k[1], 1)) for k, n in leaves.items() if k[0] == p}
        for k, want in fill(own, given[p]).items():
            assert abs(found[k] - want) <= 2


@pytest.mark.parametrize("total, epochs", [(0.5, 1), (0.5, 3), (1.0, 1), (10**9, 2), (0, 1)])
def test_mix_takes_prefixes(spark, total, epochs, monkeypatch):
    monkeypatch.setattr(mixing, "DOCS_PER_RANGE", 2)
    r = random.Random(9)
    rows = [(i, data.prose(i, r.randint(0, 30)) if i % 11 else None, "en", ("s0", "s0", "s0", "s1", None)[i % 5], 0) for i in range(150)]
    rows.append(rows[3])
    table = data.frame(spark, rows).withColumn("mix_times", F.lit(99))
    mixed = mixing.mix(table, ["lang", "source"], {"source": {"s1": 3}}, total, epochs, seed=4).cache()
    assert mixed.count() == len(rows)
    leaves = collections.defaultdict(list)
    for row in mixed.collect():
        assert row["mix_tokens"] == len((row["text"] or "").split())
        leaves[row["source"]].append(row)
    for own in leaves.values():
        budget, tokens = own[0]["mix_budget"], sum(x["mix_tokens"] for x in own)
        whole = min(budget // tokens, epochs)
        order = sorted(own, key=lambda x: hashlib.md5(f"4:{whole}:{x['doc_id']}".encode()).hexdigest())
        rest, used = budget - whole * tokens, 0
        same_place = collections.Counter()
        for x in order:
            same_place[x["doc_id"]] += x["mix_tokens"]
        stop = False
        for doc_id in dict.fromkeys(x["doc_id"] for x in order):
            used += same_place[doc_id]
            stop = stop or used > rest
            want = whole + (0 if stop or whole == epochs else 1)
            assert all(x["mix_times"] == want for x in own if x["doc_id"] == doc_id)
    out = mixing.repeated(mixed)
    assert out.count() == sum(x["mix_times"] for own in leaves.values() for x in own)
    assert set(out.columns) == set(data.SCHEMA.replace(" long", "").replace(" string", "").split(", "))
