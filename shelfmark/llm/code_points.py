"""Letters, digits and white space as the tokenizers library has them.

Libraries follow different versions of Unicode: a letter of one is unassigned in another, and is then
split and lower-cased otherwise. The library is asked once, on the driver, for the class of every code
point; ``Tables`` goes to the tasks. Texts without a code point that the versions disagree on can be
split by the faster patterns.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import regex


@dataclass(frozen=True)
class Tables:
    """Bodies of character classes, in the syntax of ``re``."""

    letters: str
    numbers: str
    spaces: str
    doubtful: str  # code points that are classed, or lower-cased, otherwise by this Python

    def spelled(self, pattern: str) -> re.Pattern:
        """A pattern with ``\\p{L}``, ``\\p{N}``, ``\\s`` and ``\\S`` written out."""
        out, inside, at = [], False, 0
        bodies = {r"\p{L}": self.letters, r"\p{N}": self.numbers, r"\s": self.spaces}
        while at < len(pattern):
            name = next((n for n in bodies if pattern.startswith(n, at)), None)
            if name:
                out.append(bodies[name] if inside else f"[{bodies[name]}]")
                at += len(name)
            elif pattern.startswith(r"\S", at) and not inside:
                out.append(f"[^{self.spaces}]")
                at += 2
            elif pattern[at] == "\\":
                out.append(pattern[at : at + 2])
                at += 2
            else:
                inside = pattern[at] == "[" or inside and pattern[at] != "]"
                out.append(pattern[at])
                at += 1
        return re.compile("".join(out))


class Doubt:
    """Whether a text has a character that versions of Unicode disagree on."""

    def __init__(self, known: Tables):
        spans = [(int(a, 16), int(b, 16)) for a, b in re.findall(r"\\U(\w{8})-\\U(\w{8})", known.doubtful)]
        self.held = bytearray(0x110000)
        for first, last in spans:
            self.held[first : last + 1] = b"\1" * (last + 1 - first)
        # nearly all texts have no character beyond the first doubtful one
        self.beyond = re.compile(f"[^\\x00-\\U{spans[0][0] - 1:08x}]") if spans else re.compile("(?!)")

    def found(self, text: str) -> bool:
        if text.isascii() or not self.beyond.search(text):
            return False
        held = self.held
        return any(held[ord(c)] for c in set(text))


def _body(points: list[int]) -> str:
    """Ascending code points as the body of a character class."""
    spans: list[list[int]] = []
    for point in points:
        if spans and spans[-1][1] == point - 1:
            spans[-1][1] = point
        else:
            spans.append([point, point])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


@lru_cache(maxsize=1)
def tables() -> Tables:
    """Ask the library about every code point but surrogates, which texts do not hold."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    every = "".join(chr(p) for p in range(1, 0x110000) if not 0xD800 <= p < 0xE000)

    def matched(pattern: str) -> set[str]:
        split = pre_tokenizers.Split(Regex(pattern + "+"), "removed", invert=True)
        return {c for piece, _ in split.pre_tokenize_str(every) for c in piece}

    found = {name: matched(name) for name in (r"\p{L}", r"\p{N}", r"\s")}
    doubtful = {c for c in every if unicodedata.category(c) == "Cn"}
    for name, own in found.items():
        doubtful |= own ^ {c for run in regex.findall(name + "+", every) for c in run}
    library = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
    marks = [c for c in every if unicodedata.combining(c)]
    # marks with others before and after them, as versions may order them otherwise
    for points, context in ((every, "{}"), *((marks, x) for x in ("\u0301{}", "{}\u0316", "\u0345{}", "{}\u0334"))):
        joined = "\0".join(map(context.format, points))
        theirs = library.normalize_str(joined).split("\0")
        ours = "σ".join(part.lower() for part in unicodedata.normalize("NFC", joined).split("Σ")).split("\0")
        doubtful |= {c for c, a, b in zip(points, theirs, ours, strict=True) if a != b}
    return Tables(*(_body(sorted(map(ord, s))) for s in (*found.values(), doubtful)))
