"""Token counts without token ids.

The number of tokens of a text is the sum, over its distinct pre-tokens, of frequency times number
of pieces. Pieces are counted once for each distinct pre-token, not once for each occurrence:

1. Texts are split in blocks of rows. Pre-tokens that are themselves vocabulary entries of one
   piece are summed on the spot (the vocabulary is the bound on that table). Of the others a block
   sends each distinct one once, with its postings (row of the block, frequency), to the bucket
   that its hash names: one shuffle row per block and bucket.
2. A bucket counts the pieces of each distinct pre-token once, joins them to the postings and
   returns, for each block, one partial sum per document. A second shuffle by block brings these
   together; a block's sums are added up while they stream by.

A pre-token that is in a large part of a block's rows is dealt by its hash and the block's, so
that its postings spread over all buckets. Blocks and the tables of a bucket are bounded in
memory: a full table is emptied and refilled, which costs time and changes nothing.

A null text counts as empty. Rows are counted one by one, repeated rows and null keys too: each
row has its own number from where it was read, and keys are only carried. Other columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from shelfmark.llm import code_points
from shelfmark.llm.batches import small
from shelfmark.llm.bpe_stream import byte_letters, read_source

BLOCK_CHARS = 8_000_000
BLOCK_ROWS = 30_000
CACHED = 300_000
# Fixed value: the split that byte-level pre-tokenisers of this kind use.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Pieces(dict):
    """Number of pieces by pre-token, counted when first asked for."""

    def __init__(self, source: str, known: code_points.Tables | None = None):
        from tokenizers import Tokenizer

        known = code_points.tables() if known is None else known

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        spec = json.loads(source)
        split = spec.get("pre_tokenizer") or {}
        if split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space"):
            raise ValueError("a byte-level pre-tokenizer without prefix space is asked for")
        if spec.get("normalizer"):
            raise ValueError("texts must be taken as they are")
        self.tokenizer = Tokenizer.from_str(source)
        self.pattern = regex.compile(PATTERN)
        self.exact = known.spelled(PATTERN)  # for texts that versions of Unicode split otherwise
        self.doubt = code_points.Doubt(known)
        specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        # vocabulary entries as text, where the model gives back one piece for them
        byte_of = {c: b for b, c in byte_letters().items()}
        entries = []
        for token in spec["model"]["vocab"]:
            try:
                entries.append(bytes(byte_of[c] for c in token).decode())
            except (KeyError, UnicodeDecodeError):
                continue
        whole = [e for e in entries if self.pattern.fullmatch(e) and not (self.special and self.special.search(e))]
        self.single = {e for e, n in zip(whole, self.count(whole)) if n == 1}

    def count(self, words: list[str]) -> list[int]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [len(e.ids) for e in found]

    def many(self, words: list[str]) -> list[int]:
        missing = [w for w in dict.fromkeys(words) if w not in self]
        if len(self) + len(missing) > CACHED:
            self.clear()
            missing = list(dict.fromkeys(words))
        self.update(zip(missing, self.count(missing)))
        return [self[w] for w in words]

    def split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text and the number of special strings in it."""
        pattern = self.exact if self.doubt.found(text) else self.pattern
        if self.special is None or not self.special.search(text):
            return pattern.findall(text), 0
        parts = self.special.split(text)
        return [w for part in parts for w in pattern.findall(part)], len(parts) - 1


@lru_cache(maxsize=2)
def _pieces(source: str, known: code_points.Tables) -> Pieces:
    return Pieces(source, known)


def default_buckets(partitions: int) -> int:
    """As many as shuffle partitions, so that all of them work and none holds more than a bucket; 128 at least."""
    return max(128, partitions)


def token_counts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None
) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row; ``path`` is a tokenizer file on the driver."""
    spark = docs.sparkSession
    source = spark.sparkContext.broadcast((read_source(path), code_points.tables()))
    if buckets is None:
        buckets = default_buckets(int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = docs.schema[id_col].dataType.simpleString()
    id_type = to_arrow_type(docs.schema[id_col].dataType)

    posting_schema = pa.schema([
        ("bucket", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("lengths", pa.list_(pa.int32())),
        ("found_in", pa.list_(pa.int32())), ("place", pa.list_(pa.int16())), ("freq", pa.list_(pa.int32())),
        ("known", pa.list_(pa.int64())), ("bytes", pa.list_(pa.int64())), ("ids", pa.list_(id_type)),
    ])

    def block_rows(block: int, texts: list[str], ids: list) -> pa.RecordBatch:
        """Shuffle rows of one block: one of what needs no counting, and one for each bucket."""
        pieces = _pieces(*source.value)
        code: dict[str, int] = {}
        single = pieces.single
        rows, codes, freqs, known, sizes = [], [], [], [], []
        for place, text in enumerate(texts):
            words, at_once = pieces.split(text)
            counted: dict[str, int] = {}
            for w in words:
                counted[w] = counted.get(w, 0) + 1
            for w, n in counted.items():
                if w in single:
                    at_once += n
                else:
                    c = code.get(w)
                    if c is None:
                        c = code[w] = len(code)
                    rows.append(place)
                    codes.append(c)
                    freqs.append(n)
            known.append(at_once)
            sizes.append(len(text.encode("utf-8", "surrogatepass")))
        out = [(block % buckets, block, None, None, None, None, None, known, sizes, ids)]
        if code:
            words = [w.encode("utf-8", "surrogatepass") for w in code]
            of = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
            codes, rows, freqs = np.array(codes), np.array(rows, np.int16), np.array(freqs, np.int32)
            in_docs = np.bincount(codes, minlength=len(words))
            wide = in_docs * 4 > len(texts)
            of[wide] += block * 2654435761 % (1 << 31)
            bucket = of % buckets
            order = np.argsort(bucket, kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            posting = np.argsort(rank[codes], kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            in_docs = in_docs[order]
            posted = np.concatenate([[0], np.cumsum(in_docs)])
            lengths = np.fromiter(map(len, words), np.int32, len(words))[order]
            for b in np.flatnonzero(np.diff(edges)).tolist():
                first, last = edges[b], edges[b + 1]
                mine = posting[posted[first] : posted[last]]
                told = zlib.compress(b"".join([words[i] for i in order[first:last].tolist()]), 1)
                out.append(
                    (b, block, told, lengths[first:last], in_docs[first:last], rows[mine], freqs[mine], None, None, None)
                )
        columns = list(zip(*out))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, posting_schema)], schema=posting_schema
        )

    def to_postings(batches) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        texts, ids, chars = [], [], 0
        for batch in small(batches):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                texts.append(text.as_py() or "")
                ids.append(key)
                chars += len(texts[-1])
                if chars >= BLOCK_CHARS or len(texts) >= BLOCK_ROWS:
                    yield block_rows(block, texts, ids)
                    texts, ids, chars, block = [], [], 0, block + 1
        if texts:
            yield block_rows(block, texts, ids)

    sum_schema = pa.schema([
        ("block", pa.int64()), ("place", pa.list_(pa.int16())), ("n", pa.list_(pa.int64())),
        ("bytes", pa.list_(pa.int64())), ("ids", pa.list_(id_type)),
    ])

    def to_sums(batches) -> Iterator[pa.RecordBatch]:
        """Count the bucket's words, join them to their postings, and sum by document."""
        for batch in small(batches):
            out = []
            for row in range(batch.num_rows):
                at = {n: batch.column(n)[row] for n in batch.schema.names}
                block = at["block"].as_py()
                if not at["words"].is_valid:
                    out.append((block, None, at["known"].values.to_numpy(), at["bytes"].values.to_numpy(), at["ids"].as_py()))
                    continue
                text = zlib.decompress(at["words"].as_py())
                ends = np.cumsum(at["lengths"].values.to_numpy()).tolist()
                words = [text[i:j].decode("utf-8", "surrogatepass") for i, j in zip([0, *ends], ends)]
                pieces = np.array(_pieces(*source.value).many(words), np.int64)
                each = np.repeat(pieces, at["found_in"].values.to_numpy()) * at["freq"].values.to_numpy()
                places, at_place = np.unique(at["place"].values.to_numpy(), return_inverse=True)
                out.append((block, places, np.bincount(at_place, each).astype(np.int64), None, None))
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, sum_schema)], schema=sum_schema
                )

    def to_documents(batches) -> Iterator[pa.RecordBatch]:
        """Add up the sums of one block after another: its rows stand together."""
        block, total, ids, sizes = None, None, None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, id_type), pa.array(sizes, pa.int64()), pa.array(total[: len(ids)], pa.int64())],
                ["id", "n_bytes", "n_tokens"],
            )

        for batch in batches:
            for row in range(batch.num_rows):
                at = {n: batch.column(n)[row] for n in batch.schema.names}
                if at["block"].as_py() != block:
                    if block is not None:
                        yield told()
                    block, total = at["block"].as_py(), np.zeros(BLOCK_ROWS, np.int64)
                n = at["n"].values.to_numpy()
                if at["place"].is_valid:
                    total[at["place"].values.to_numpy()] += n
                else:
                    total[: len(n)] += n
                    ids, sizes = at["ids"].as_py(), at["bytes"].values.to_numpy()
        if block is not None:
            yield told()

    pair = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    posted = pair.mapInArrow(
        to_postings,
        "bucket int, block long, words binary, lengths array<int>, found_in array<int>, place array<smallint>, "
        f"freq array<int>, known array<long>, bytes array<long>, ids array<{kind}>",
    )
    partial = posted.repartition("bucket").mapInArrow(
        to_sums, f"block long, place array<smallint>, n array<long>, bytes array<long>, ids array<{kind}>"
    )
    counted = partial.repartition("block").sortWithinPartitions("block").mapInArrow(
        to_documents, f"id {kind}, n_bytes long, n_tokens long"
    )
    return counted.withColumnRenamed("id", id_col)
