"""Column expressions over package names, keywords, URLs and polymorphic JSON fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from shelfmark.functions import fixed


def text_or_field(value: Column, field: str) -> Column:
    """A variant that is a string, or an object with a string under ``field``."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise(
        F.try_variant_get(value, f"$.{field}", "string")
    )


def repository_part(url: Column, part: str, host: str = r"github\.com", suffix: str = r"\.git") -> Column:
    """``owner`` or ``repo`` of a repository URL, null when the URL is not on ``host``."""
    pattern = rf"{host}[:/]([^/]+)/([^/#?]+)"
    if part == "owner":
        return F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))
    repo = F.regexp_replace(F.regexp_extract(url, pattern, 2), rf"{suffix}$", "")
    return F.nullif(repo, F.lit(""))


def repository_slug(url: Column, host: str = r"github\.com", suffix: str = r"\.git") -> Column:
    """``owner__repo``; null when either part is missing."""
    return F.concat(
        repository_part(url, "owner", host, suffix), F.lit("__"), repository_part(url, "repo", host, suffix)
    )


def declared_type(
    keywords: Column,
    markers: Sequence[str] = fixed.TYPE_MARKERS,
    prefix: str = fixed.TYPE_PREFIX,
    default: str = "unknown",
) -> Column:
    """The first keyword, in the package's own order, that is a marker, without its prefix."""
    first = F.get(F.filter(keywords, lambda k: k.isin(*markers)), F.lit(0))
    return F.coalesce(F.replace(first, F.lit(prefix), F.lit("")), F.lit(default))


def visible_keywords(
    keywords: Column,
    hidden: Sequence[str] = (fixed.CATALOGUE_KEYWORD, *fixed.TYPE_MARKERS),
    keep: int = 8,
) -> Column:
    """Leading keywords that are not markers."""
    shown = F.filter(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: ~k.isin(*hidden))
    return F.slice(shown, 1, keep)


def name_words(name: Column, affix: str = "pi") -> Column:
    """Words of the unscoped name without a leading or trailing ``affix`` word."""
    base = F.element_at(F.split(name, "/"), -1)
    bare = F.regexp_replace(base, rf"^{affix}(?:[-_]+|$)|[-_]+{affix}$", "")
    return F.trim(F.regexp_replace(bare, "[-_]", " "))


def unscoped(name: Column) -> Column:
    return F.element_at(F.split(name, "/"), -1)


def safe_key(name: Column) -> Column:
    """A file-system key for a name: ``@scope/x`` becomes ``scope__x``."""
    return F.ltrim(F.regexp_replace(name, "[/@]", "__"), F.lit("_"))


def best_author(
    owner: Column, publisher: Column, author: Column, bots: Sequence[str] = fixed.CI_ACCOUNTS
) -> Column:
    """Repository owner, else publisher, else author; accounts in ``bots`` do not count."""
    def person(who: Column) -> Column:
        return F.when(~who.isin(*bots) & (who != ""), who)

    return F.coalesce(owner, person(publisher), person(author))


def serves_several(
    keywords: Column,
    description: Column,
    body: Column,
    words: Sequence[str] = fixed.MULTI_KEYWORDS,
    phrases: Sequence[str] = fixed.MULTI_PHRASES,
    body_chars: int | None = None,
    at_least: int = 2,
) -> Column:
    """A telling keyword, or ``at_least`` distinct phrases in the description or body."""
    text = F.lower(F.coalesce(description, F.lit("")))
    lead = F.coalesce(body, F.lit(""))
    lead = F.lower(lead if body_chars is None else F.substring(lead, 1, body_chars))
    hits = F.lit(0)
    for phrase in phrases:
        hits = hits + F.when(text.contains(phrase) | lead.contains(phrase), 1).otherwise(0)
    tagged = F.arrays_overlap(keywords, F.array(*[F.lit(w) for w in words]))
    return F.coalesce(tagged, F.lit(False)) | (hits >= at_least)


def map_value(mapping: Column, key: str) -> Column:
    return F.try_element_at(mapping, F.lit(key))


def tail_values(values: Column, keep: int = 26) -> Column:
    """The last ``keep`` elements; shorter arrays stay whole."""
    return F.slice(values, F.greatest(F.size(values) - (keep - 1), F.lit(1)), keep)
