"""N-gram Jaccard join, size-aware: subsets for small sets, inverted lists for large ones.

A text's set are its distinct word shingles, as 64-bit hashes. Two sets are linked when their
Jaccard similarity reaches the threshold. Equal sets are folded into one node first.

*Small sets* (up to a boundary): two sets of sizes s and s' are linked exactly when they share a
subset of a fixed size that follows from s and s'. All subsets of that size are enumerated and
meet by their hash; a group that shares one is linked through one member, not in pairs.

*Large sets*: inverted lists are scanned. Before that, two counts discard sets that cannot be
linked, so that lists are made for few sets only: of the first shingles in hash order a linked set
shares a known number with some other set; of all its shingles it shares the threshold. Lists hold
each set's rarest shingles, as many as any linked pair must meet in, with their places, which bound
what two sets can share. The members of a list are compared with the one whose shingles are the
most common; what is then in one component needs no comparing any more, and only members of
different components are paired.

The *boundary* is the size with the least cost, from the number of sets of each small size: the
subsets to enumerate below it against the list entries to scan above. A pair that lies across the
boundary is found by lists, which also hold the sets just below it.

Results are exact. Every table that is used twice is written to the shared folder. Shingle lists
may be hot; they are counted with combining before the shuffle, and joins by shingle are split by
Spark at run time.

A null text, or one without words, has an empty set: no link, a component of its own. With fewer
words than a shingle has, the whole sequence is the one shingle. Repeated rows are linked like any
equal texts; a component's id is its smallest document id, null only if it has no other. Very long
texts cost memory in proportion to their own length. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from shelfmark.llm.batches import small
from shelfmark.session import stage, unstage

CACHED = 250_000
LARGEST_SMALL = 36  # sets above are never enumerated
SLACK = 5  # per cent of a set's size that the first count asks for
BROADCAST_ROWS = 500_000  # of a key and nothing else
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """64-bit hash of each word met before; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _Hashes()


def shingle_set(text: bytes, words_each: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a UTF-8 text, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    own = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    size = min(words_each, len(own))
    n = len(own) - size + 1
    mixed = np.full(n, size, np.uint64)
    for shift in range(size):
        mixed = (mixed ^ own[shift : shift + n]) * _MIX
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))


class Threshold:
    """Jaccard similarity of at least ``numerator / denominator``, in whole numbers."""

    def __init__(self, numerator: int, denominator: int):
        if not 0 < numerator <= denominator:
            raise ValueError("the threshold lies above 0 and is at most 1")
        self.a, self.b = numerator, denominator

    def least(self, size: int) -> int:
        """Shingles that a set of this size shares with any set it is linked to."""
        return -(-self.a * size // self.b)

    def overlap(self, one: int, two: int) -> int:
        """Shingles that linked sets of these sizes share at least."""
        return -(-self.a * (one + two) // (self.a + self.b))

    def partners(self, size: int) -> range:
        return range(self.least(size), self.b * size // self.a + 1)

    def least_column(self, size: Column) -> Column:
        return F.ceil(size * self.a / self.b)

    def slack(self, size: int) -> int:
        return size * SLACK // 100 + 1

    def shared_first(self, size: int) -> int:
        """Shingles in the first part of a set that a linked set has in its first part too."""
        return self.slack(self.least(size))

    def first(self, size: int) -> int:
        """Length of the first part of a set."""
        return min(size, size - self.least(size) + self.slack(size))

    def subsets(self, size: int) -> int:
        return sum(comb(size, self.overlap(size, other)) for other in self.partners(size) if self.overlap(size, other) <= size)


def boundary(histogram: dict[int, int], t: Threshold) -> int:
    """The largest size of enumerated sets, by cost: subset keys below, list entries above."""
    scan = {s: 2 * t.first(s) + s for s in range(1, LARGEST_SMALL + 2)}
    best, best_cost = 0, None
    for limit in range(LARGEST_SMALL + 1):
        listed = t.least(limit + 1)
        cost = sum(n * t.subsets(s) for s, n in histogram.items() if s <= limit)
        cost += sum(n * scan[s] for s, n in histogram.items() if listed <= s <= LARGEST_SMALL)
        if best_cost is None or cost < best_cost:
            best, best_cost = limit, cost
    return best


# Sets of documents


def signatures(docs: DataFrame, id_col: str, text_col: str, words_each: int, t: Threshold) -> DataFrame:
    """(id, n, digest, part) of every row: size and digest of its set, and the set's first part.

    Sets that may be small have all their shingles in ``part``.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sizes, digests, parts = [], [], []
            for text in batch.column(1):
                own = shingle_set(text.as_py() or b"", words_each)
                sizes.append(len(own))
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                parts.append(own if len(own) <= LARGEST_SMALL else own[: t.first(len(own))])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                    pa.array(parts, pa.list_(pa.int64())),
                ],
                ["id", "n", "digest", "part"],
            )

    pair = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    shape = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("n", T.LongType())]
    shape += [T.StructField("digest", T.BinaryType()), T.StructField("part", T.ArrayType(T.LongType()))]
    return pair.mapInArrow(run, T.StructType(shape))


def whole_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words_each: int) -> DataFrame:
    """(node, n, shingles) of the wanted (node, n, id, digest), from the texts again."""
    pair = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    ids = _fitting(wanted.select(F.col("id").alias("wanted_id")).distinct())
    chosen = pair.join(ids, pair["id"].eqNullSafe(ids["wanted_id"]), "left_semi")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets = [shingle_set(text.as_py() or b"", words_each) for text in batch.column(1)]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(sets, pa.list_(pa.int64()))],
                ["id", "digest", "shingles"],
            )

    shape = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("digest", T.BinaryType())]
    made = chosen.mapInArrow(run, T.StructType([*shape, T.StructField("shingles", T.ArrayType(T.LongType()))]))
    joined = wanted.withColumnRenamed("id", "node_id").join(made, "digest").filter(F.col("id").eqNullSafe(F.col("node_id")))
    return joined.select("node", "n", "shingles")


def shared_by_two(postings: DataFrame) -> DataFrame:
    """(token, df) of the tokens found twice or more."""
    return postings.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")


# Links


def small_links(sets: DataFrame, t: Threshold) -> DataFrame:
    """(a, b) links between enumerated sets (node, n, part), through one member of each group."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            keys, nodes, sides = [], [], []
            sizes = batch.column(1).to_pylist()
            for node, n, part in zip(batch.column(0).to_pylist(), sizes, batch.column(2)):
                own = part.values.to_numpy()
                for other in t.partners(n):
                    shared = t.overlap(n, other)
                    if shared > n:
                        continue
                    low, high = min(n, other), max(n, other)
                    for chosen in combinations(range(n), shared):
                        mark = f"{shared},{low},{high}:".encode() + own[list(chosen)].tobytes()
                        keys.append(xxhash.xxh3_128_digest(mark))
                        nodes.append(node)
                        sides.append(2 if low == high else int(n > low))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(nodes, pa.int64()), pa.array(sides, pa.int32())],
                ["key", "node", "side"],
            )

    keyed = sets.select("node", "n", "part").mapInArrow(run, "key binary, node long, side int")
    keyed = stage(keyed, "subset-keys")  # one row for each subset of a small set
    of_side = lambda side: F.min(F.when(F.col("side") == side, F.col("node")))
    hubs = keyed.groupBy("key").agg(
        of_side(0).alias("low"), of_side(1).alias("high"), of_side(2).alias("same"),
        F.min("node").alias("first"), F.max("node").alias("last"),
    ).filter("first < last")
    # of two sizes, each side is linked to a member of the other; of one size, all to the first
    hub = F.when(F.col("side") == 0, F.col("high")).when(F.col("side") == 1, F.col("low")).otherwise(F.col("same"))
    met = keyed.join(hubs, "key").withColumn("hub", hub).filter("hub <> node")
    return met.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, t: Threshold) -> DataFrame:
    """The pairs (a, b, ...) whose sets are linked."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    both = pairs.join(one, "a").join(two, "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - shared
    return both.filter(shared * t.b >= union * t.a).drop("set_a", "set_b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge: the smallest node that it is connected to.

    Alternates between linking all larger neighbours and all smaller ones to the smallest, until
    nothing changes: every node is then linked to its root. The number of rounds grows with the
    logarithm of the nodes.
    """
    links = stage(edges.select("a", "b").filter("a <> b"), "links")
    state = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        larger = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
        # now every edge has its smaller end first
        low = larger.groupBy("b").agg(F.min("a").alias("m"))
        smaller = larger.join(low, "b").select(
            F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), "b"))).alias("e")
        )
        last, links = links, stage(smaller.select("e.a", "e.b").filter("a <> b").distinct(), "links")
        unstage(last)
        before, state = state, tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
    own = F.array(F.struct(F.col("b").alias("node"), F.col("a").alias("root")), F.struct(F.col("a").alias("node"), F.col("a").alias("root")))
    return links.select(F.explode(own).alias("e")).select("e.node", "e.root").distinct()


def join_lists(lists: DataFrame, sets: DataFrame, t: Threshold) -> list[DataFrame]:
    """Links (a, b) that connect what linked sets in common lists connect.

    ``lists`` has (token, node, n, left, weight): the size of the node's set, how many of its
    shared shingles are not before this one in the common order, and how central it is; ``sets``
    has (node, shingles). Two sets share at most the lesser ``left`` of their first common list, so
    other pairs need no look. First the members of each list are compared with its most central one;
    then members that are still in different components with each other. Links of the second kind
    are between components' roots.
    """
    near = (
        (F.col("n_a") * t.b >= F.col("n_b") * t.a)
        & (F.col("n_b") * t.b >= F.col("n_a") * t.a)
        & (F.least("left_a", "left_b") * (t.a + t.b) >= (F.col("n_a") + F.col("n_b")) * t.a)
    )

    def side(name: str) -> list:
        return [F.col(c).alias(f"{c}_{name}") for c in ("node", "n", "left", "root")]

    hubs = lists.groupBy("token").agg(
        F.max_by(F.struct("node", "n", "left"), F.struct("weight", "node")).alias("hub")
    )
    starred = lists.join(hubs, "token").select(
        F.col("hub.node").alias("a"), F.col("hub.n").alias("n_a"), F.col("hub.left").alias("left_a"),
        F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("left").alias("left_b"),
    )
    stars = stage(verified(starred.filter((F.col("a") != F.col("b")) & near).select("a", "b").distinct(), sets, t), "links")

    roots = components(stars)
    placed = lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_lists = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    members = stage(placed.join(open_lists.select("token"), "token", "left_semi"), "members")
    apart = (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & near
    pairs = members.select("token", *side("a")).join(members.select("token", *side("b")), "token").filter(apart)
    pairs = pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "root_a", "root_b").distinct()
    rest = verified(pairs, sets, t).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct()
    return [stars, stage(rest, "links")]


def linked(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words_each: int = 5,
    threshold: tuple[int, int] = (80, 100),
) -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    told = _linked_sets(docs, id_col, text_col, words_each, threshold)
    return told.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _linked_sets(docs: DataFrame, id_col: str, text_col: str, words_each: int, threshold: tuple[int, int]) -> DataFrame:
    """(id, n, digest, root, component_id) of every row; ``root`` is a number that a component's sets share."""
    t = Threshold(*threshold)
    rows = stage(signatures(docs, id_col, text_col, words_each, t), "signatures")
    nodes = stage(
        rows.filter("n > 0").groupBy("digest").agg(F.min("id").alias("id"), F.max("n").alias("n"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    counts = nodes.filter(F.col("n") <= LARGEST_SMALL).groupBy("n").count().collect()
    limit = boundary({r["n"]: r["count"] for r in counts}, t)
    from_size = t.least(limit + 1)

    # a document that is there twice gives its tokens twice: the counts then discard less, never more
    parts = rows.filter("n > 0").select("id", "digest", "part").join(
        nodes.select("digest", "node", "n", F.col("id").alias("node_id")), "digest"
    ).filter(F.col("id").eqNullSafe(F.col("node_id"))).select("node", "n", "part")
    parts = stage(parts, "parts")
    edges = small_links(parts.filter(F.col("n") <= limit), t)

    slack = lambda size: F.floor(size * SLACK / 100) + 1
    size = F.col("n")
    first = F.least(size, size - t.least_column(size) + slack(size)).cast("int")
    large = parts.filter(size >= from_size)
    postings = large.select("node", "n", F.explode(F.slice("part", F.lit(1), first)).alias("token"))
    again = postings.join(shared_by_two(postings), "token")
    hopeful = again.groupBy("node", "n").agg(F.count("*").alias("shared")).filter(
        F.col("shared") >= slack(t.least_column(size))
    )
    wanted = stage(nodes.join(hopeful.select("node"), "node"), "hopeful")

    sets = stage(whole_sets(docs, wanted, id_col, text_col, words_each), "sets")
    tokens = sets.select("node", "n", F.explode("shingles").alias("token"))
    common = (
        tokens.join(shared_by_two(tokens), "token")
        .groupBy("node", "n")
        .agg(F.collect_list(F.struct("df", "token")).alias("common"))
        .filter(F.size("common") >= t.least_column(size))
    )
    # the rarest first, one order for all sets
    rarest = (F.size("common") - t.least_column(size) + 1).cast("int")
    weight = F.aggregate("common", F.lit(0).cast("long"), lambda sum_, e: sum_ + e["df"]) / size
    ordered = common.select("node", "n", F.sort_array("common").alias("common"), weight.alias("weight"))
    lists = ordered.select(
        "node", "n", "weight", F.size("common").alias("m"), F.posexplode(F.slice("common", F.lit(1), rarest)).alias("place", "entry")
    )
    lists = stage(
        lists.select(F.col("entry.token").alias("token"), "node", "n", (F.col("m") - F.col("place")).alias("left"), "weight"),
        "lists",
    )
    held = lists.select("node").distinct()
    kept_sets = stage(sets.join(held, "node", "left_semi").dropDuplicates(["node"]), "kept-sets")
    for links in join_lists(lists, kept_sets, t):
        edges = edges.unionByName(links)
    roots = components(edges)
    # what follows reads the roots and these: the rest is not needed any more
    told = stage(rows.select("id", "n", "digest"), "sizes")
    unstage(rows, parts, wanted, sets, lists, kept_sets)
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    by_set = named.join(least, "root").select("digest", "root", "component_id")
    out = told.join(by_set, "digest", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", "n", "digest", "root", own.alias("component_id"))


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 5, threshold: tuple[int, int] = (80, 100)
) -> DataFrame:
    """One row of each component, with its columns: that of the smallest id, a null id being the largest.

    Where an id is there more than once its rows are told apart by their sets, so that one row of a
    component stays also then; of rows with one id and one set the one with the smallest text. Rows
    without words are linked with nothing: of those with one id and one text, one stays.
    """
    marked = stage(_linked_sets(docs, id_col, text_col, words_each, threshold), "marked")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "digest")
    heads = marked.filter("n > 0").groupBy("root").agg(F.min(order).alias("head"))
    heads = heads.select(F.col("head.id").alias("id"), F.col("head.digest").alias("digest"), F.lit(True).alias("stays"))
    bare = marked.filter("n = 0").select("id", "digest", F.lit(True).alias("stays")).distinct()
    every = marked.groupBy("id").agg(F.count("*").alias("rows"))
    again = every.filter((F.col("rows") > 1) | F.col("id").isNull()).select("id")
    kept = stage(heads.unionByName(bare), "kept")
    again = stage(again.select(F.col("id").alias("_again_id")), "again")

    quoted = F.col(f"`{id_col}`")
    repeats = again.count()
    once = kept.join(again, kept["id"].eqNullSafe(again["_again_id"]), "left_anti") if repeats else kept
    ids = once.select(F.col("id").alias("_kept_id"))
    single = docs.join(_fitting(ids), quoted.eqNullSafe(F.col("_kept_id")), "left_semi")
    if not repeats:
        return single
    rows = docs.join(_fitting(again), quoted.eqNullSafe(F.col("_again_id")), "left_semi").select(
        quoted.alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )

    @F.pandas_udf("binary")
    def digest(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: xxhash.xxh3_128_digest(shingle_set(text or b"", words_each).tobytes()))

    dealt = rows.withColumn("digest", digest("text"))
    wanted = kept.select(F.col("id").alias("_kept_id"), F.col("digest").alias("_kept_digest"))
    there = dealt.join(
        wanted, dealt["id"].eqNullSafe(wanted["_kept_id"]) & (dealt["digest"] == wanted["_kept_digest"]), "left_semi"
    )
    # of sets with words one row for each id and set, without words one for each id and text
    empty = F.lit(xxhash.xxh3_128_digest(shingle_set(b"", words_each).tobytes()))
    by_text = F.when(F.col("digest") == empty, F.coalesce("text", F.lit(b"")))
    first = there.groupBy("id", "digest", by_text.alias("bare"), (F.col("digest") == empty).alias("is_bare")).agg(
        F.min_by("row", F.struct(F.col("text").isNull(), "text")).alias("row")
    )
    return single.unionByName(first.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))


def _fitting(ids: DataFrame) -> DataFrame:
    """Ids to join by: broadcast while they are few, as they are a key and nothing else."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
