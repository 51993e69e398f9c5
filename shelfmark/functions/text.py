"""Column expressions over prose. Everything runs inside the row: no shuffle, no Python."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from shelfmark.functions import fixed

WORD = r"[\p{L}\p{N}_]{2,}"
LETTER_RUN = r"[a-zA-Z]{4,}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once per row, even where ``body`` uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def compose(description: Column, body: Column, body_chars: int | None = None) -> Column:
    """Description, a space, and the body (whole unless ``body_chars`` is given)."""
    tail = F.coalesce(body, F.lit(""))
    if body_chars is not None:
        tail = F.substring(tail, 1, body_chars)
    return F.concat(F.coalesce(description, F.lit("")), F.lit(" "), tail)


def lead(text: Column, chars: int, one_line: bool = False) -> Column:
    """The first ``chars`` characters for display."""
    cut = F.substring(F.coalesce(text, F.lit("")), 1, chars)
    return F.replace(cut, F.lit("\n"), F.lit(" ")) if one_line else cut


def tokens(text: Column, stop_words: Sequence[str] = (), pattern: str = WORD) -> Column:
    """Lower-cased tokens in order, stop words removed."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*stop_words)) if stop_words else found


def ngrams(words: Column, low: int = 1, high: int = 1) -> Column:
    """All n-grams of ``words`` for n in [low, high], joined by a space."""
    parts = []
    for n in range(low, high + 1):
        if n == 1:
            parts.append(words)
            continue
        count = F.greatest(F.size(words) - (n - 1), F.lit(0))
        joined = F.slice(words, F.lit(1), count)
        for shift in range(1, n):
            following = F.slice(words, F.lit(1 + shift), count)
            joined = F.zip_with(joined, following, lambda a, b: F.concat_ws(" ", a, b))
        parts.append(joined)
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def clean_markdown(text: Column) -> Column:
    """Markdown punctuation becomes spaces."""
    return F.regexp_replace(text, fixed.MARKDOWN, " ")


def plain_prose(text: Column) -> Column:
    """Tags, URLs, markdown links and emphasis marks become spaces."""
    return F.regexp_replace(text, fixed.NOT_PROSE, " ")


def naming_words(description: Column, body: Column, body_chars: int | None = None) -> Column:
    """Distinct words of a document reduced to letters, as used in cluster names."""
    lead_text = F.coalesce(body, F.lit(""))
    if body_chars is not None:
        lead_text = F.substring(lead_text, 1, body_chars)
    text = F.lower(F.concat(F.coalesce(description, F.lit("")), F.lit(" "), plain_prose(lead_text)))
    letters = F.split(F.regexp_replace(text, r"[^\p{L}\s]+", ""), r"\s+")
    return F.array_distinct(letters)


def folded_words(text: Column) -> Column:
    """Distinct runs of a-z in the lower-cased text."""
    return F.array_distinct(
        F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z ]+", " ")), " +")
    )


def derivation_lines(
    text: Column, phrases: Sequence[str] = fixed.DERIVATION_PHRASES, chars: int = 200
) -> Column:
    """Lines that name an origin, trimmed and cut for display."""
    pattern = r"(?i)\b(" + "|".join(phrases) + r")\b"
    lines = F.filter(F.split(text, r"\R"), lambda line: line.rlike(pattern))
    return F.transform(lines, lambda line: F.substring(F.regexp_replace(line, r"^\s+|\s+$", ""), 1, chars))


def joined_title(words: Column, keep: int = 3) -> Column:
    """The first words in title case, joined by `` / ``."""
    return F.concat_ws(" / ", F.transform(F.slice(words, 1, keep), lambda w: F.initcap(w)))


def title_from_name(name: Column) -> Column:
    """A readable title from a package name."""
    base = F.element_at(F.split(name, "/"), -1)
    return F.initcap(F.replace(F.replace(base, F.lit("pi-"), F.lit("")), F.lit("-"), F.lit(" ")))
