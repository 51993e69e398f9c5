"""SimHash fingerprints, and a search by permuted block tables.

A text's terms are its word shingles (lower-cased words, ``SHINGLE`` in a row; the whole sequence
if it has fewer). Each distinct term has a 64-bit hash and the number of its occurrences as weight;
every bit of a hash votes with plus or minus that weight, and the sign of the sum is the bit of the
fingerprint. A text without words has the fingerprint of no votes: zero.

``within_radius`` finds all fingerprints at most ``radius`` bits from those of a query set. The 64
bits are cut into ``blocks`` blocks; two fingerprints at most ``radius`` bits apart agree in at
least ``blocks - radius`` of them, so a table for each choice of that many blocks, keyed by their
bits, holds every such pair. Equal fingerprints are folded before the tables are made, so copies
cost one row, and are counted by their number.

``edited`` gives each row the beginning of the document that follows by key, without a global
window: keys are dealt out in ranges, and each range sees the first key of the next one.

A null text counts as empty. Rows with one key each get their own fingerprint; the next document
of a key is the next greater key, of several rows with that key the smallest text; null keys come
first. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from shelfmark.llm.batches import small
from shelfmark.session import stage

SHINGLE = 3
BITS = 64
CACHED = 250_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """64-bit hash of each word met before; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _Hashes()


def term_hashes(text: str) -> np.ndarray:
    """The hash of every shingle of a text, repeats included."""
    words = text.lower().encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = max(1, len(own) - SHINGLE + 1)
    mixed = np.full(n, len(own) if len(own) < SHINGLE else SHINGLE, np.uint64)
    for shift in range(min(SHINGLE, len(own))):
        mixed = (mixed ^ own[shift : shift + n]) * _MIX
        mixed ^= mixed >> np.uint64(29)
    return mixed


def fingerprint_of(text: str) -> int:
    """Signed votes of all terms, weighted by their number of occurrences."""
    terms = term_hashes(text)
    if not len(terms):
        return 0
    bits = np.unpackbits(terms.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    votes = 2 * bits.sum(0, dtype=np.int64) - len(terms)
    return int.from_bytes(np.packbits(votes > 0).tobytes(), "big")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits of two fingerprints in hexadecimal."""
    as_number = lambda c: F.conv(c, 16, -10).cast("long")
    return 1.0 - F.bit_count(as_number(a).bitwiseXOR(as_number(b))) / BITS


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_chars, fingerprint in hexadecimal) of every row."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [t.as_py() or "" for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(map(len, texts), pa.int64()),
                    pa.array([f"{fingerprint_of(t):016x}" for t in texts], pa.string()),
                ],
                ["id", "n_chars", "fingerprint"],
            )

    pair = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    shape = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_chars", T.LongType())]
    return pair.mapInArrow(run, T.StructType([*shape, T.StructField("fingerprint", T.StringType())])).withColumnRenamed("id", id_col)


def blocks_for(rows: int, radius: int) -> int:
    """The fewest blocks whose keys tell so many fingerprints apart: a key then holds about one by chance."""
    blocks = radius + 2
    while blocks < BITS and 2 ** (BITS * (blocks - radius) / blocks) < rows:
        blocks += 1
    return blocks


def block_tables(prints: Column, blocks: int, radius: int) -> Column:
    """(table, key) of a 64-bit number for each choice of ``blocks - radius`` blocks."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(number).alias("table"), prints.bitwiseAND(F.lit(signed).cast("long")).alias("key")))
    return F.array(*keys)


def within_radius(
    queries: DataFrame, prints: DataFrame, radius: int = 3, blocks: int | None = None, column: str = "fingerprint"
) -> DataFrame:
    """(query, found, distance, copies): distinct fingerprints of ``prints`` near each distinct query.

    ``copies`` is the number of rows of ``prints`` with the found fingerprint. The number of blocks
    follows from that of the fingerprints, unless it is given.
    """
    blocks = blocks_for(prints.count(), radius) if blocks is None else blocks
    if not 0 <= radius < blocks:
        raise ValueError("more blocks than the radius are needed")
    number = F.conv(column, 16, -10).cast("long")
    asked = queries.filter(F.col(column).isNotNull()).select(number.alias("query")).distinct()
    held = prints.filter(F.col(column).isNotNull()).groupBy(number.alias("found")).agg(F.count("*").alias("copies"))
    q = asked.select("query", F.inline(block_tables(F.col("query"), blocks, radius)))
    p = held.select("found", "copies", F.inline(block_tables(F.col("found"), blocks, radius)))
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("found")))
    near = q.join(p, ["table", "key"]).filter(distance <= radius)
    pairs = near.groupBy("query", "found").agg(F.first("copies").alias("copies"), F.first(distance).alias("distance"))
    as_hex = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return pairs.select(as_hex("query").alias("query"), as_hex("found").alias("found"), "distance", "copies")


def counted_within(
    rows: DataFrame, asked: Column, radius: int = 3, blocks: int | None = None, column: str = "fingerprint", out_col: str = "n_within"
) -> DataFrame:
    """The rows with the number of all rows whose fingerprint is within the radius, their own included.

    It is null for rows that ``asked`` does not choose. Rows that it does not choose are not joined.
    """
    chosen = F.coalesce(asked, F.lit(False))
    near = within_radius(rows.filter(chosen), rows, radius, blocks, column)
    counts = near.groupBy(F.col("query").alias("_query")).agg(F.sum("copies").alias(out_col))
    told = rows.filter(chosen).join(counts, F.col(column) == F.col("_query"), "left").drop("_query")
    return told.unionByName(rows.filter(~chosen).withColumn(out_col, F.lit(None).cast("long")))


def _name(key: str) -> Column:
    """A key as a string that is never null, so that plain equality joins find null keys too."""
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))


def next_keys(keys: DataFrame, column: str) -> DataFrame:
    """(key, next): each distinct key and the next greater one; the first after the last; nulls first.

    Spark deals the keys out in ranges, in order; a range is one window, and only the first key of
    each range (one for each shuffle partition) goes through a window of all ranges.
    """
    distinct = keys.select(F.col(column).alias("key")).distinct()
    placed = stage(distinct.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "keys")
    inside = Window.partitionBy("part").orderBy(F.asc_nulls_first("key"))
    one = F.struct("key")  # tells a null key from no key
    ahead = placed.withColumn("next", F.lead(one).over(inside))
    firsts = placed.groupBy("part").agg(F.min(F.struct(F.col("key").isNotNull().alias("some"), "key")).alias("first"))
    parts = Window.partitionBy(F.lit(0)).orderBy("part")
    whole = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("part", F.coalesce(F.lead("first").over(parts), F.first("first").over(whole)).alias("after"))
    found = F.coalesce(F.col("next"), F.struct(F.col("after.key").alias("key")))
    return ahead.join(after, "part").select("key", found.getField("key").alias("next"))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited form, and their likeness.

    The edited form is the text whose last quarter of code points (rounded down) is replaced by
    the first as many, or all, of the next document. Result: id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next. Of several rows with the next key, the
    one whose text has the smallest hash is the next document.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("key"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    links = next_keys(own, "key")
    quarter = F.floor(F.char_length("text") / 4).cast("int")
    needs = own.groupBy(F.col("key").alias("needing")).agg(F.max(quarter).alias("need"))
    wanted = links.join(needs, links["key"].eqNullSafe(needs["needing"])).select(
        _name("key").alias("for_name"), _name("next").alias("of_name"), "key", "next", "need"
    )
    # the texts are dealt by the key's name once: both joins read that exchange
    pair = own.select(_name("key").alias("name"), "text")
    # where a key is there more than once, the row with the smallest hash is the next document for both columns
    mark = F.xxhash64("text")
    beginnings = (
        pair.join(wanted, F.col("name") == F.col("of_name"))
        .groupBy("for_name")
        .agg(
            F.min_by(F.expr("substring(text, 1, need)"), mark).alias("begin"),
            F.max("key").alias("key"), F.max("next").alias("next"),
        )
    )
    joined = pair.join(beginnings, F.col("name") == F.col("for_name")).select("key", "next", "text", "begin", mark.alias("mark"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for text, begin in zip(batch.column(2), batch.column(3)):
                text, begin = text.as_py(), begin.as_py()
                n = len(text)
                changed = text[: n - n // 4] + begin[: n // 4]
                rows.append((
                    n, hashlib.sha256(changed.encode("utf-8", "surrogatepass")).digest(),
                    fingerprint_of(text).to_bytes(8, "big"), fingerprint_of(changed).to_bytes(8, "big"),
                ))
            counts, digests, prints, others = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), batch.column(4), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()),
                    pa.array(prints, pa.binary()), pa.array(others, pa.binary()),
                ],
                ["key", "next", "mark", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"],
            )

    kind = docs.schema[id_col].dataType
    shape = [T.StructField(n, kind) for n in ("key", "next")] + [T.StructField(n, T.LongType()) for n in ("mark", "n_chars")]
    shape += [T.StructField(n, T.BinaryType()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    told = stage(joined.mapInArrow(run, T.StructType(shape)), "prints")
    following = told.groupBy(F.col("key").alias("after")).agg(F.min_by("fingerprint", "mark").alias("next_fingerprint"))
    as_hex = lambda c: F.lower(F.hex(c))
    return told.join(following, told["next"].eqNullSafe(following["after"])).select(
        F.col("key").alias(id_col), "n_chars", as_hex("edited_sha256").alias("edited_sha256"),
        as_hex("fingerprint").alias("fingerprint"), as_hex("edited_fingerprint").alias("edited_fingerprint"),
        likeness(as_hex("fingerprint"), as_hex("edited_fingerprint")).alias("near_edited"),
        likeness(as_hex("fingerprint"), as_hex("next_fingerprint")).alias("near_next"),
    )
