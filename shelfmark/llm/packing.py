"""Packing token sequences: first-fit decreasing with a tournament tree of bin capacities.

Documents are dealt to partitions and ordered there by a hash, so that the documents that follow each
other are a random group, and every group, closed at a number of tokens, is packed on its own. Inside a
group whole sequences are cut off documents longer than one; the remainders, longest first, go each
into the first bin with room. The bins are the leaves of a tree in which every node holds the larger
room below it, so that the first fitting bin is found on the way down, in as many steps as the tree
is deep.

First fit leaves some room in most bins. Documents may be cut, so the emptiest bins are taken apart and
their pieces fill that room, the longest where they fit whole. What is left of the last bin becomes
sequences whose lengths are powers of two, which need no padding.

The shuffle moves each text once. A task holds the ids of one group at a time. The order inside a
partition depends on ids and texts alone, so that a task that is run again gives the same rows.

Defined cases: a null text is empty, and has the closing id alone. Rows that repeat, null ids and
other columns do not matter: every row is packed. An empty table gives no rows. Special strings inside
a text become their ids, as in the library. Texts are encoded in the stretches between spaces, line ends and
tabs, each of which the library sees once while it is remembered; that gives the same ids for vocabularies
that drop white space and split there, and others are refused.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from shelfmark.llm.batches import small
from shelfmark.llm.bpe_stream import byte_letters

GROUP_TOKENS = 1 << 20
REMEMBERED = 200_000  # stretches whose ids are held at a time, and as many older ones
LONGEST = 64  # characters of a stretch that is remembered
SIGNS = ".,;:!?#*$%&"
SMALL = re.compile("[a-zß-öø-ÿ]+")  # words that normalising leaves as they are
LATIN = re.compile(r"[\x00-\xFF]*")  # every version of Unicode lower-cases these alike, and they do not compose


class Tournament:
    """Bins in the order they were opened; every node holds the larger room below it."""

    def __init__(self, capacity: int, bins: int):
        self.capacity, self.opened, self.leaves = capacity, 0, 1
        while self.leaves < bins:
            self.leaves *= 2
        self.room = [0] * (2 * self.leaves)

    def first(self, size: int) -> int:
        """The first bin with room for ``size``, a new one if no open one has; its room becomes smaller."""
        room, node = self.room, 1
        if room[1] >= size:
            while node < self.leaves:
                node *= 2
                if room[node] < size:
                    node += 1
            left = room[node] - size
        else:
            node, left = self.leaves + self.opened, self.capacity - size
            self.opened += 1
        found = node - self.leaves
        room[node] = left
        while node > 1:
            node //= 2
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
        return found


def first_fit(sizes: list[tuple[int, int, int]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Bins of pieces (length, document, start), from pieces up to ``capacity``, longest first."""
    bins: list[list] = []
    tree = Tournament(capacity, len(sizes))
    for piece in sorted(sizes, key=lambda p: (-p[0], p[1], p[2])):
        at = tree.first(piece[0])
        if at == len(bins):
            bins.append([])
        bins[at].append(piece)
    return bins


def fill(bins: list[list[tuple[int, int, int]]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """The same pieces, some of them cut, in full bins and in bins whose lengths are powers of two."""
    length = lambda pieces: sum(p[0] for p in pieces)
    whole = lambda n: n == capacity or n & (n - 1) == 0
    done = [b for b in bins if whole(length(b))]
    short = sorted((b for b in bins if not whole(length(b))), key=length, reverse=True)
    loose: list[tuple[int, int, int]] = []  # longest last
    for pieces in short:
        loose_room = capacity - length(pieces)
        while loose_room:
            if not loose:
                if short[-1] is pieces:
                    break
                loose = sorted(short.pop())
            fits = next((i for i in range(len(loose) - 1, -1, -1) if loose[i][0] <= loose_room), None)
            size, doc, start = loose.pop(-1 if fits is None else fits)
            taken = min(size, loose_room)
            pieces.append((taken, doc, start))
            if taken < size:
                loose.append((size - taken, doc, start + taken))
                loose.sort()
            loose_room -= taken
        if not loose_room:
            done.append(pieces)
            if short[-1] is pieces:
                break
        else:
            loose = pieces
            break
    return done + powers(loose)


def powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Sequences whose lengths are the powers of two that the pieces add up to."""
    out, left = [], sorted(pieces, key=lambda p: (-p[0], p[1], p[2]))[::-1]
    total = sum(p[0] for p in left)
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        out.append([])
        while room:
            size, doc, start = left.pop()
            taken = min(size, room)
            out[-1].append((taken, doc, start))
            if taken < size:
                left.append((size - taken, doc, start + taken))
            room -= taken
    return out


def pack(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (length, document, start) that hold every token of every document once."""
    full, rest = [], []
    for doc, size in enumerate(lengths):
        cut = size // capacity * capacity
        full += [[(capacity, doc, start)] for start in range(0, cut, capacity)]
        if size > cut:
            rest.append((size - cut, doc, cut))
    return full + fill(first_fit(rest, capacity), capacity)


class _Ids(dict):
    """Ids of stretches without a space, as little-endian unsigned 32-bit numbers.

    When full, the stretches so far become the older half; those that are met again move back.
    """

    def __init__(self, source: str):
        super().__init__({"": b""})
        self.older: dict[str, bytes] = {}
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tokenizers

        self.library = tokenizers.Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        apart, together = (self.library.encode(t, add_special_tokens=False).ids for t in ("a b \n\t", "ab"))
        if apart != [i for t in "ab" for i in self.library.encode(t, add_special_tokens=False).ids] or apart == together:
            raise ValueError("the vocabulary does not split at white space")
        self.model = self.library.model
        letters = byte_letters()
        self.spelled = {c: "".join([letters[b] for b in chr(c).encode()]) for c in range(0xDF, 0x100)}
        self.direct = self._direct(json.loads(source))

    def _direct(self, spec: dict) -> bool:
        """Whether small Latin words go to the model as they are, but for the letters that stand for their bytes."""
        steps = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
        steps = steps.get("normalizers", [steps])
        known = all(
            s["type"] in ("NFC", "Lowercase") or s["type"] == "Replace" and s["pattern"].get("Regex") == r"\s+" for s in steps
        )
        apart = not any(SMALL.search(t["content"]) and t["content"].isalpha() for t in spec.get("added_tokens", []))
        probes = ["".join(map(chr, [*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100)])), "the", "é"]
        encode = self.library.encode
        return known and apart and all(self._word(w) == encode(w, add_special_tokens=False).ids for w in probes)

    def _word(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.spelled))]

    def __missing__(self, stretch: str) -> bytes:
        # an end of signs is a piece of its own, and a word is remembered without it
        word = stretch.rstrip(SIGNS)
        if word != stretch and "<" not in word and LATIN.fullmatch(word) and word[-1:].isalpha():
            return self[word] + self[stretch[len(word) :]]
        found = self.older.get(stretch)
        if found is None:
            if self.direct and SMALL.fullmatch(stretch):
                ids = self._word(stretch)
            else:
                ids = self.library.encode(stretch, add_special_tokens=False).ids
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(stretch) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[stretch] = found
        return found

    def of(self, text: str | None, closing: int) -> np.ndarray:
        """The ids of a text, and the closing id."""
        text = text or ""
        if LATIN.fullmatch(text) and "<" not in text:  # special strings are found before capitals become small
            text = text.lower()
        stretches = text.replace("\n", " ").replace("\t", " ").split(" ")
        parts = [self[s] for s in stretches]
        parts.append(struct.pack("<I", closing))
        return np.frombuffer(b"".join(parts), "<u4")


@lru_cache(maxsize=2)
def _tokenizer(source: str) -> _Ids:
    return _Ids(source)


def _groups(batches: Iterator[pa.RecordBatch], ids_of: _Ids, closing: int, most: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    names, ids, held = [], [], 0
    for batch in small(batches):
        for name, text in zip(batch.column(0), batch.column(1)):
            names.append(name.as_py())
            ids.append(ids_of.of(text.as_py(), closing))
            held += len(ids[-1])
            if held >= most:
                yield names, ids
                names, ids, held = [], [], 0
    if ids:
        yield names, ids


def packed(
    docs: DataFrame,
    path: str,
    capacity: int = 4096,
    closing: int = 2,
    seed: int = 0,
    group_tokens: int = GROUP_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: (id, start, length, ids, doc_tokens, sequence_id, offset).

    ``ids`` are the piece's, little-endian unsigned 32-bit numbers. ``path`` is a tokenizer file on the driver.
    """
    if capacity < 1:
        raise ValueError("a sequence holds one token or more")
    with open(path, encoding="utf-8") as file:
        source = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for names, ids in _groups(batches, _tokenizer(source.value), closing, group_tokens):
            rows = []
            for pieces in pack([len(i) for i in ids], capacity):
                offset = 0
                for size, doc, start in pieces:
                    rows.append((names[doc], start, size, ids[doc][start : start + size].tobytes(), len(ids[doc]), number, offset))
                    offset += size
                number += 1
            for at in range(0, len(rows), 256):
                columns = zip(*rows[at : at + 256])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], shape.names)

    from_row = docs.schema[id_col].dataType
    shape = T.StructType(
        [T.StructField(id_col, from_row), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
         T.StructField("ids", T.BinaryType())]
        + [T.StructField(n, T.LongType()) for n in ("doc_tokens", "sequence_id", "offset")]
    )
    kinds = [None, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    pair = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    random = pair.withColumn("_place", F.xxhash64(F.lit(seed), "id", "text"))
    grouped = random.repartition("_place").sortWithinPartitions("_place", "id")
    return grouped.select("id", "text").mapInArrow(run, shape)

