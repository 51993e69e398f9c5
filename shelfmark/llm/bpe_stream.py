"""Streaming BPE: a transducer with bounded lookahead, and a decoder that is a state machine.

``Encoder`` takes a text in pieces of any size. Normalisation, pre-tokenisation and merging hold
back only what later characters could still change:

* the text is cut where composition cannot reach across (before a character that starts anew);
* a run of one character class is open until another class follows;
* inside an open run, tokens that end more than the *sufficient lookahead* of the merge list
  before the end of the run are stable, and are emitted.

The lookahead is computed from the merge list. Whether a merge at some place happens depends on
what lies to its right only through merges of higher priority that overlap its right end, which
in turn depend on merges of yet higher priority overlapping theirs: the longest such chain is
the farthest a decision can look. So the memory is constant however long the text or the run is, but
for runs of combining marks, which normalisation has to sort as a whole.

``Decoder`` takes ids one by one. With a byte-level decoder it keeps at most three bytes of an
unfinished character; without one, tokens are joined by spaces.

``encode_documents`` runs both over a table: partitions in parallel, rows one after another, no
shuffle. The tokenizer file is read on the driver and sent along (its size is that of the
vocabulary), so executors need no file of their own.

A null text counts as empty: no tokens, empty decoded text. Special strings inside a text become
their special ids, as in the library. Repeated rows, null keys and other columns do not matter.
"""

from __future__ import annotations

import codecs
import copy
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame, functions as F, types as T

from shelfmark.llm import code_points
from shelfmark.llm.batches import small

CHUNK = 1 << 16  # characters of a text that are looked at together
CACHED_WORDS = 150_000  # words whose ids are remembered at a time, and as many older ones
SHORT_BYTES = 32  # words up to this are merged in a plain loop
CACHED_CHARS = 48  # longer words are not remembered
LAST_SPACE = regex.compile(r"(?r)\s")
# the runs that can be arbitrarily long: letters, and anything but letters, digits and white space
RUNS = (r"\p{L}+", r"[^\s\p{L}\p{N}]+")
# str.split takes these for white space, the patterns do not
SEPARATORS = "\x1c\x1d\x1e\x1f"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    for shift, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + shift)
    return letters


def sufficient_lookahead(merges: list[tuple[tuple[str, ...], int]]) -> int:
    """Symbols to the right of a token that can decide about it, from (symbols, right length) by rank.

    ``reach[prefix]`` is the farthest that any merge so far whose symbols begin with ``prefix``
    depends on, counted from its own start. A merge depends on earlier merges that begin inside it
    and reach over its end.
    """
    reach: dict[tuple[str, ...], int] = {}
    farthest = 0
    for symbols, _ in merges:
        size = len(symbols)
        own = size
        for start in range(1, size):
            own = max(own, start + reach.get(symbols[start:], 0))
        farthest = max(farthest, own)
        for end in range(1, size):
            prefix = symbols[:end]
            if reach.get(prefix, 0) < own:
                reach[prefix] = own
    return farthest


class Model:
    """Vocabulary, merges and the steps around them, from a tokenizer file's JSON.

    Characters are classed and normalised as the library does, by ``known``; texts without characters
    that versions of Unicode disagree on may be split by :meth:`plain`, with the same result.
    """

    def __init__(self, source: str, known: code_points.Tables | None = None):
        known = code_points.tables() if known is None else known
        spec = json.loads(source)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("only byte-level BPE without fallback or prefix is read")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        # the same by ids, for short words: what a rank makes, and the ranks of each id with the next
        self.made = [self.vocab.get(a + b) for a, b in pairs]
        self.right_of: dict[int, dict[int, int]] = {i: {} for i in self.vocab.values()}
        for (a, b), rank in self.ranks.items():
            if a in self.vocab and b in self.vocab:
                self.right_of[self.vocab[a]][self.vocab[b]] = rank
        self.decimal = {i: str(i) for i in self.vocab.values()}
        self.letters = byte_letters()
        self.bytes_of = {c: b for b, c in self.letters.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
            raise ValueError("special tokens must be plain strings")
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_pattern = regex.compile("|".join(map(regex.escape, longest_first))) if longest_first else None
        self.inner_ids = [self.vocab.get(self.letters[b]) for b in range(256)]
        self.last_ids = [self.vocab.get(self.letters[b] + self.suffix) for b in range(256)]
        self.token_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self._read_normalizer(spec.get("normalizer"))
        self.library_normalizer = tokenizers.Tokenizer.from_str(source).normalizer
        split = self._read_splitter(spec["pre_tokenizer"])
        self.doubt = code_points.Doubt(known)
        self.pattern, self.runs = known.spelled(split), [known.spelled(r) for r in RUNS]
        self.space = re.compile(f"[{known.spaces}]")
        self.exact = True
        if self.pattern.search(" "):
            raise ValueError("white space must separate words")
        self.split = split
        self.byte_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.lookahead = sufficient_lookahead([(self._symbols(a + b), len(b)) for a, b in pairs])
        self.longest = max((len(self._symbols(t)) for t in self.vocab), default=1)

    def _symbols(self, token: str) -> tuple[str, ...]:
        """A token's characters; the mark of a word's end belongs to the last one."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return (*body[:-1], body[-1] + self.suffix)
        return tuple(token)

    def _read_normalizer(self, spec: dict | None) -> None:
        steps = [] if spec is None else spec["normalizers"] if spec["type"] == "Sequence" else [spec]
        self.normal_steps: list[tuple] = []
        for step in steps:
            if step["type"] == "NFC":
                self.normal_steps.append(("NFC",))
            elif step["type"] == "Lowercase":
                self.normal_steps.append(("lower",))
            elif step["type"] == "Replace" and (step["pattern"].get("Regex"), step["content"]) == (r"\s+", " "):
                continue  # white space only separates words
            elif step["type"] == "Replace":
                self.normal_steps.append(("replace", regex.compile(step["pattern"]["Regex"]), step["content"]))
            else:
                raise ValueError(f"normalizer {step['type']} is not known")

    def plain(self) -> Model:
        """The same for texts without doubtful characters."""
        other = copy.copy(self)
        other.pattern, other.runs = regex.compile(self.split), [regex.compile(r) for r in RUNS]
        other.exact = False
        return other

    def last_space(self, text: str) -> int:
        """Where the text after the last white space begins."""
        if not self.exact:
            found = LAST_SPACE.search(text)
            return found.end() if found else 0
        return max((m.end() for m in self.space.finditer(text)), default=0)

    def _read_splitter(self, spec: dict) -> str:
        steps = spec["pretokenizers"] if spec["type"] == "Sequence" else [spec]
        split = next((s for s in steps if s["type"] == "Split"), None)
        if split is None or not split["invert"] or split["behavior"] != "Removed":
            raise ValueError("the pre-tokenizer must keep the matches of a pattern")
        return split["pattern"]["Regex"]

    def normalize(self, text: str) -> str:
        if self.exact and self.library_normalizer is not None:
            return self.library_normalizer.normalize_str(text)
        for step in self.normal_steps:
            if step[0] == "NFC":
                text = unicodedata.normalize("NFC", text)
            elif step[0] == "replace":
                text = step[1].sub(step[2], text)
            elif "Σ" in text:  # lower character by character: no special form at a word's end
                text = "σ".join(part.lower() for part in text.split("Σ"))
            else:
                text = text.lower()
        return text

    def told(self, tokens: list[str]) -> tuple[str, str]:
        """Ids joined by spaces, and, where tokens are not bytes, what the decoder makes of the ids."""
        ids = [self.vocab[t] for t in tokens]
        return " ".join(map(str, ids)), "" if self.byte_decoder else decode(self, ids)

    def word(self, word: str) -> tuple[str, str]:
        """What is told of a whole word; ids are merged in a plain loop where it is short."""
        spelled = word.encode("utf-8", "surrogatepass")
        if not 0 < len(spelled) <= SHORT_BYTES:
            return self.told(self.merge(self.symbols_of(word, True)))
        inner = self.inner_ids
        ids = [inner[b] for b in spelled]
        ids[-1] = self.last_ids[spelled[-1]]
        if None in ids:
            return self.told(self.merge(self.symbols_of(word, True)))
        right_of, made, none = self.right_of, self.made, len(self.made)
        near = [right_of[a].get(b, none) for a, b in zip(ids, ids[1:])]
        while near:
            best = min(near)
            if best == none:
                break
            i = near.index(best)
            ids[i] = own = made[best]
            del ids[i + 1], near[i]
            if i < len(near):
                near[i] = right_of[own].get(ids[i + 1], none)
            if i:
                near[i - 1] = right_of[ids[i - 1]].get(own, none)
        text = "" if self.byte_decoder else " ".join([self.token_of[i] for i in ids])
        return " ".join([self.decimal[i] for i in ids]), text

    def symbols_of(self, word: str, ended: bool) -> list[str]:
        letters = self.letters
        symbols = [letters[b] for b in word.encode("utf-8", "surrogatepass")]
        if ended and symbols:
            symbols[-1] += self.suffix
        return symbols

    def merge(self, symbols: list[str]) -> list[str]:
        """Apply the merges by rank, leftmost first; O(n log n)."""
        n = len(symbols)
        if n < 2:
            return symbols
        ranks, text = self.ranks, list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            rank = ranks.get((text[i], text[i + 1]))
            if rank is not None:
                heap.append((rank, i, text[i], text[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i] if text[i] is not None else n
            if text[i] != left or j >= n or text[j] != right:
                continue
            text[i], text[j] = left + right, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                rank = ranks.get((text[i], text[k]))
                if rank is not None:
                    heapq.heappush(heap, (rank, i, text[i], text[k]))
            h = before[i]
            if h >= 0:
                rank = ranks.get((text[h], text[i]))
                if rank is not None:
                    heapq.heappush(heap, (rank, h, text[h], text[i]))
        return [t for t in text if t is not None]


class _Words(dict):
    """Ids of words as decimal numbers joined by spaces, with their decoded form.

    Stretches between white space are looked up too, where the model is plain: one is split into its words when
    it is first met. When full, the words so far become the older half; those that are met again move back.
    """

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.older: dict[str, tuple[str, str]] = {}

    def __missing__(self, word: str) -> tuple[str, str]:
        found = self.older.get(word)
        if found is None:
            model = self.model
            words = [word] if model.exact else model.pattern.findall(word)
            if words == [word]:
                found = model.word(word)
            else:
                ids, texts = zip(*[self[w] for w in words]) if words else ((), ())
                found = " ".join(ids), "" if model.byte_decoder else " ".join(texts)
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHED_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


class Encoder:
    """One text at a time: ``feed`` pieces, then ``finish``; both give the tokens that became stable.

    They come word by word, or as part of a long word: ids as decimal numbers joined by spaces, and
    the decoded form. ``words`` may be shared by encoders of one model.
    """

    def __init__(self, model: Model, words: _Words | None = None):
        self.model = model
        self.words = _Words(model) if words is None else words
        self.raw = ""  # not yet normalised
        self.open = ""  # normalised, from the start of the last run
        self.inside: list[str] | None = None  # symbols of a long run whose start has been emitted
        self.special = model.special_pattern
        self.held = max(map(len, model.special), default=1) - 1

    # cutting the raw text

    def _cut(self) -> int:
        """Where the raw text can be cut: before a character that starts anew, outside special strings."""
        text = self.raw
        i = len(text) - max(self.held, 1)
        while i > 0:
            c = text[i]
            if c.isascii() or (
                not unicodedata.combining(c)
                and unicodedata.category(c) not in ("Mn", "Mc", "Me", "Cn")
                and not "\u1160" <= c <= "\u11ff"
            ):
                break
            i -= 1
        if i > 0 and self.special:
            # not inside a special string
            for s in self.model.special:
                at = text.find(s, max(0, i - len(s) + 1), i + len(s) - 1)
                if 0 <= at < i < at + len(s):
                    i = at
        return max(i, 0)

    def feed(self, piece: str) -> list[tuple[str, str]]:
        self.raw += piece
        cut = self._cut()
        ready, self.raw = self.raw[:cut], self.raw[cut:]
        return self._take(ready)

    def finish(self) -> list[tuple[str, str]]:
        ready, self.raw = self.raw, ""
        return self._take(ready) + self._close()

    def _take(self, ready: str) -> list[tuple[str, str]]:
        if not ready:
            return []
        if self.special is None or not self.special.search(ready):
            return self._text(ready)
        at, out = 0, []
        for match in self.special.finditer(ready):
            out += self._text(ready[at : match.start()]) + self._close()
            out.append((str(self.model.special[match[0]]), match[0]))
            at = match.end()
        return out + self._text(ready[at:])

    # words

    def _text(self, piece: str) -> list[tuple[str, str]]:
        """Ids of the words that this piece closes; what follows the last white space stays open."""
        text, out = self.model.normalize(piece), []
        if self.inside is not None:
            run = self.run.match(text)
            end = run.end() if run else 0
            for at in range(0, end, CHUNK):
                self.inside += self.model.symbols_of(text[at : min(end, at + CHUNK)], False)
                out += self._stable()
            if end == len(text):
                return out
            out += self._close()
            text = text[end:]
        text = self.open + text
        closed = self.model.last_space(text)
        self.open = text[closed:]
        if self.model.exact or any(c in text for c in SEPARATORS):
            found = self.model.pattern.findall(text, 0, closed)
        else:
            found = text[:closed].split()
        out += map(self.words.__getitem__, found)
        return out + self._enter() if len(self.open) > CACHED_CHARS else out

    def _enter(self) -> list[tuple[str, str]]:
        """The open stretch is long: emit its whole words, and go into the last one if that is long."""
        runs = list(self.model.pattern.finditer(self.open))
        if not runs:
            self.open = ""
            return []
        # only the last run can grow, but a short one could still join those before it ('r, 're)
        stay = 1 if len(runs[-1][0]) > 4 else 3
        out = [self.words[m[0]] for m in runs[:-stay]]
        runs = runs[-stay:]
        self.open = self.open[runs[0].start() :]
        if len(runs) == 1 and len(self.open) > 2 * (self.model.lookahead + self.model.longest):
            self.run = next((r for r in self.model.runs if r.fullmatch(self.open)), None)
            if self.run is not None:
                self.inside, self.open = self.model.symbols_of(self.open, False), ""
                out += self._stable()
        return out

    def _stable(self) -> list[tuple[str, str]]:
        """The tokens of the open run that end before the lookahead."""
        look, out = self.model.lookahead + self.model.longest, []
        while len(self.inside) > 2 * look:
            window = self.inside[: 2 * look + CHUNK // 16]
            done, tokens = 0, []
            for token in self.model.merge(window):
                if done + len(token) > len(window) - look:
                    break
                done += len(token)
                tokens.append(token)
            out.append(self.model.told(tokens))
            self.inside = self.inside[done:]
        return out

    def _close(self) -> list[tuple[str, str]]:
        """The open run ends here."""
        out = []
        if self.inside is not None:
            symbols, self.inside = self.inside, None
            symbols[-1] += self.model.suffix
            out.append(self.model.told(self.model.merge(symbols)))
        words, self.open = self.model.pattern.findall(self.open), ""
        return out + [self.words[w] for w in words]


class Decoder:
    """Ids to text, one by one; keeps at most the bytes of an unfinished character."""

    def __init__(self, model: Model):
        self.model = model
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace") if model.byte_decoder else None
        self.first = True

    def push(self, token_id: int) -> str:
        token = self.model.token_of[token_id]
        if not self.model.byte_decoder:
            out = token if self.first else " " + token
            self.first = False
            return out
        bytes_of = self.model.bytes_of
        if all(c in bytes_of for c in token):
            return self.utf8.decode(bytes(bytes_of[c] for c in token))
        return self.utf8.decode(token.encode())

    def finish(self) -> str:
        return self.utf8.decode(b"", True) if self.model.byte_decoder else ""


def encode(model: Model, text: str, pieces: Iterable[int] = ()) -> list[int]:
    """All ids of a text, fed in pieces that end at the given places."""
    encoder, ids, at = Encoder(model), [], 0
    for end in [*pieces, len(text)]:
        for part, _ in encoder.feed(text[at:end]):
            ids += map(int, part.split())
        at = end
    for part, _ in encoder.finish():
        ids += map(int, part.split())
    return ids


def decode(model: Model, ids: Iterable[int]) -> str:
    machine = Decoder(model)
    return "".join([machine.push(i) for i in ids]) + machine.finish()


@lru_cache(maxsize=2)
def _models(source: str, known: code_points.Tables) -> tuple[Model, _Words, Model, _Words]:
    model = Model(source, known)
    plain = model.plain()
    return model, _Words(model), plain, _Words(plain)


def encoder_of(source: str, known: code_points.Tables, text: str) -> Encoder:
    """An encoder for one text; words met before are shared by the encoders of a process."""
    model, words, plain, plain_words = _models(source, known)
    if not model.doubt.found(text):
        return Encoder(plain, plain_words)
    return Encoder(model, words)


def digests(source: str, known: code_points.Tables, text: str | None) -> tuple[int, str, str]:
    """(tokens, SHA-256 of the ids, SHA-256 of the decoded text) with constant memory.

    With a byte-level decoder ids go through one decoder in turn, as characters may be parted
    between them; without one, each word's ids have gone through it when the word was first met.
    """
    text = text or ""
    encoder = encoder_of(source, known, text)
    model = encoder.model
    of_ids, of_text, machine = hashlib.sha256(), hashlib.sha256(), Decoder(model)
    count, gap = 0, ""

    def take(parts: list[tuple[str, str]]) -> None:
        nonlocal count, gap
        if ("", "") in parts:
            parts = [p for p in parts if p[0]]
        if not parts:
            return
        ids, texts = zip(*parts)
        joined = " ".join(ids)
        count += joined.count(" ") + 1
        of_ids.update((gap + joined).encode())
        if model.byte_decoder:
            of_text.update("".join([machine.push(int(i)) for i in joined.split(" ")]).encode())
        else:
            of_text.update((gap + " ".join(texts)).encode())
        gap = " "

    for at in range(0, len(text), CHUNK):
        take(encoder.feed(text[at : at + CHUNK]))
    take(encoder.finish())
    of_text.update(machine.finish().encode())
    return count, of_ids.hexdigest(), of_text.hexdigest()


def read_source(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row; ``path`` is a tokenizer file on the driver."""
    source = docs.sparkSession.sparkContext.broadcast((read_source(path), code_points.tables()))
    of_id = T.StructField(id_col, docs.schema[id_col].dataType)

    def run(batches):
        for batch in small(batches):
            rows = [digests(*source.value, t.as_py()) for t in batch.column(1)]
            counts, ids, texts = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    digest = [T.StructField(n, T.StringType()) for n in ("ids_sha256", "decoded_sha256")]
    pair = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return pair.mapInArrow(run, T.StructType([of_id, T.StructField("n_tokens", T.LongType()), *digest]))


def encode_rows(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """Every row with its columns and the ids of its text as an array."""
    source = docs.sparkSession.sparkContext.broadcast((read_source(path), code_points.tables()))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pd.Series) -> pd.Series:
        def one(text):
            text = text or ""
            encoder, out = encoder_of(*source.value, text), []
            for at in range(0, len(text), CHUNK):
                for part, _ in encoder.feed(text[at : at + CHUNK]):
                    out += map(int, part.split())
            for part, _ in encoder.finish():
                out += map(int, part.split())
            return out

        return texts.map(one)

    kept = [c for c in docs.columns if c.lower() != out_col.lower()]
    return docs.select(*[docs[f"`{c}`"] for c in kept], ids(docs[f"`{text_col}`"]).alias(out_col))


def decode_rows(tokens: DataFrame, path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """Every row with its columns and the text of its ids; null ids are null text."""
    source = tokens.sparkSession.sparkContext.broadcast((read_source(path), code_points.tables()))

    @F.pandas_udf("string")
    def texts(ids: pd.Series) -> pd.Series:
        model = _models(*source.value)[0]
        return ids.map(lambda x: None if x is None else decode(model, map(int, x)))

    kept = [c for c in tokens.columns if c.lower() != out_col.lower()]
    return tokens.select(*[tokens[f"`{c}`"] for c in kept], texts(tokens[f"`{ids_col}`"]).alias(out_col))
