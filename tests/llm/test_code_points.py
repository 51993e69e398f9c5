"""Every code point, assigned or not, is split and normalised as by the library.

Of the large uniform blocks (unassigned, private, ideographs, Hangul) every 16th is taken, unless
SHELFMARK_ALL_CODE_POINTS is set; all of them pass, in four minutes.
"""

import os
import random
import unicodedata

import tokenizers

from shelfmark.llm import bpe_stream, code_points, token_counts
from shelfmark.llm.queries import tokenizer

EVERY = [chr(p) for p in range(0x110000) if not 0xD800 <= p < 0xE000]


def uniform(c):
    name = unicodedata.name(c, "")
    return unicodedata.category(c) in ("Cn", "Co") or name.startswith(("CJK UNIFIED", "HANGUL SYLLABLE", "TANGUT", "EGYPTIAN"))


POINTS = EVERY if os.environ.get("SHELFMARK_ALL_CODE_POINTS") else [c for n, c in enumerate(EVERY) if n % 16 == 0 or not uniform(c)]
CONTEXT = "a{0}b {0}{0}1{0} !{0}é{0}!\u0316{0}'s \u0301{0}"


def chunks():
    """Texts of many code points, those that versions of Unicode agree on apart from the others."""
    doubt = code_points.Doubt(code_points.tables())
    for wanted in (False, True):
        points = [c for c in POINTS if doubt.found(c) == wanted]
        for at in range(0, len(points), 4000):
            yield "\n".join(CONTEXT.format(c) for c in points[at : at + 4000])


def own_ids(source, text):
    encoder = bpe_stream.encoder_of(source, code_points.tables(), text)
    parts = encoder.feed(text) + encoder.finish()
    return [int(i) for part, _ in parts for i in part.split()], [t for _, t in parts if t]


def test_encoder_and_decoder():
    path = tokenizer("word_bpe_49k.json")
    library, source = tokenizers.Tokenizer.from_file(path), bpe_stream.read_source(path)
    for text in chunks():
        ids, decoded = own_ids(source, text)
        wanted = library.encode(text, add_special_tokens=False).ids
        assert ids == wanted and " ".join(decoded) == library.decode(wanted, skip_special_tokens=False)


def test_counts():
    path = tokenizer("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    pieces = token_counts.Pieces(bpe_stream.read_source(path))
    for text in chunks():
        words, specials = pieces.split(text)
        single = sum(w in pieces.single for w in words)
        counted = specials + single + sum(pieces.many([w for w in words if w not in pieces.single]))
        assert counted == len(library.encode(text, add_special_tokens=False).ids)


def test_both_ways_of_splitting_agree():
    """Texts without doubtful characters give the same ids in both variants."""
    source = bpe_stream.read_source(tokenizer("word_bpe_49k.json"))
    model = bpe_stream.Model(source)
    r = random.Random(3)
    letters = [c for c in EVERY[:0x3000] if not model.doubt.found(c)]
    for _ in range(50):
        text = "".join(r.choice(letters) if r.random() < 0.5 else r.choice("ab 1'!\n") for _ in range(300))
        assert bpe_stream.encode(model, text) == bpe_stream.encode(model.plain(), text)


def test_classes_are_written_out():
    known = code_points.tables()
    pattern = known.spelled(r"\p{L}+|[^\s\p{L}\p{N}]+|\s+(?!\S)|\.")
    assert pattern.findall("ab!  .") == ["ab", "!", " ", "."]
    assert known.spelled(r"[\p{N}]").fullmatch("٣") and not known.spelled(r"\p{N}").fullmatch("a")
