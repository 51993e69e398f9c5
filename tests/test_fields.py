"""Column expressions on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import catalogue, numeric, text as text_functions


def value(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


def words(*items):
    return F.array(*[F.lit(i) for i in items])


@pytest.mark.parametrize(
    "url, owner, repo",
    [
        ("git+https://github.com/a/pi-exit.git", "a", "pi-exit"),
        ("https://github.com/a/curl.md.git", "a", "curl.md"),
        ("git@github.com:a/b.git", "a", "b"),
        ("https://github.com/a/b#readme", "a", "b"),
        ("https://gitlab.com/a/b", None, None),
        (None, None, None),
    ],
)
def test_repository_parts(spark, url, owner, repo):
    column = F.lit(url).cast("string")
    assert value(spark, catalogue.repository_part(column, "owner")) == owner
    assert value(spark, catalogue.repository_part(column, "repo")) == repo
    slug = value(spark, catalogue.repository_slug(column))
    assert slug == (f"{owner}__{repo}" if owner else None)


@pytest.mark.parametrize(
    "keywords, expected",
    [(["pi-package", "pi-skill", "pi-extension"], "skill"), (["pi"], "unknown"), (None, "unknown")],
)
def test_declared_type(spark, keywords, expected):
    column = F.lit(None).cast("array<string>") if keywords is None else words(*keywords)
    assert value(spark, catalogue.declared_type(column)) == expected


@pytest.mark.parametrize(
    "name, expected",
    [("@x/pi-foo-bar", "foo bar"), ("foo-pi", "foo"), ("pi", ""), ("pilens", "pilens"), ("pi_a_b", "a b")],
)
def test_name_words(spark, name, expected):
    assert value(spark, catalogue.name_words(F.lit(name))) == expected


def test_safe_key(spark):
    assert value(spark, catalogue.safe_key(F.lit("@scope/x"))) == "scope__x"
    assert value(spark, catalogue.safe_key(F.lit("x"))) == "x"


def test_best_author(spark):
    none = F.lit(None).cast("string")
    bot = F.lit("GitHub Actions")
    assert value(spark, catalogue.best_author(none, bot, F.lit("Ann"))) == "Ann"
    assert value(spark, catalogue.best_author(F.lit("owner"), F.lit("p"), F.lit("Ann"))) == "owner"
    assert value(spark, catalogue.best_author(none, F.lit("p"), F.lit("Ann"))) == "p"
    assert value(spark, catalogue.best_author(none, bot, bot)) is None
    assert value(spark, catalogue.best_author(none, none, none)) is None


def test_serves_several(spark):
    plain = words("x")
    none = F.lit(None).cast("string")
    flag = lambda kw, d, b, **o: value(spark, catalogue.serves_several(kw, d, b, **o))
    assert flag(plain, F.lit("Windsurf and OpenCode"), none) is True
    assert flag(plain, F.lit("Windsurf only"), none) is False
    assert flag(words("codex"), none, none) is True
    assert flag(F.lit(None).cast("array<string>"), none, F.lit("windsurf, opencode")) is True
    late = F.lit("x" * 500 + " windsurf opencode")
    assert flag(plain, none, late) is True
    assert flag(plain, none, late, body_chars=400) is False


@pytest.mark.parametrize(
    "raw, expected", [('"u"', "u"), ('{"url":"u"}', "u"), ('{"type":"git"}', None), (None, None)]
)
def test_polymorphic_field(spark, raw, expected):
    parsed = F.parse_json(F.lit(raw).cast("string"))
    assert value(spark, catalogue.text_or_field(parsed, "url")) == expected


def test_tail_values(spark):
    numbers = lambda n: F.array(*[F.lit(i) for i in range(n)])
    assert value(spark, catalogue.tail_values(numbers(3))) == [0, 1, 2]
    assert value(spark, catalogue.tail_values(numbers(30))) == list(range(4, 30))


def test_visible_keywords(spark):
    many = words("pi-package", "a", "pi-skill", *[f"k{i}" for i in range(10)])
    assert value(spark, catalogue.visible_keywords(many)) == ["a"] + [f"k{i}" for i in range(7)]


def test_whole_days(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    assert value(spark, numeric.whole_days(at("2026-01-01 12:00:00"), at("2026-01-03 11:00:00"))) == 1
    assert value(spark, numeric.whole_days(at("2026-01-01 12:00:00"), at("2026-01-03 12:00:00"))) == 2


@pytest.mark.parametrize(
    "values, expected",
    [
        ([7, 3], "blockbuster"), ([4, 3, 3], "contested"), ([1, 1, 1], "long-tail"), ([0, 0], "long-tail"),
        ([6, 4], "contested"), ([35, 33, 32], "long-tail"),
    ],
)
def test_dominance(spark, values, expected):
    assert value(spark, numeric.dominance(F.lit(max(values)), F.lit(sum(values)))) == expected


def test_half_even_and_scale(spark):
    assert value(spark, numeric.half_even(F.lit(0.125), 2)) == 0.12
    assert value(spark, numeric.half_even(F.lit(0.375), 2)) == 0.38
    assert value(spark, numeric.unit_scale(F.lit(5.0), F.lit(5.0), F.lit(5.0))) == -1.0
    assert value(spark, numeric.bin_index(F.lit(1.0), F.lit(0.0), F.lit(1.0), 40)) == 39
    assert value(spark, numeric.bin_index(F.lit(5.0), F.lit(5.0), F.lit(5.0), 40)) == 0


def test_ngrams(spark):
    grams = lambda text, stops=(): value(
        spark, text_functions.ngrams(text_functions.tokens(F.lit(text), stops), 1, 2)
    )
    assert grams("alpha the beta", ("the",)) == ["alpha", "beta", "alpha beta"]
    assert grams("alpha") == ["alpha"]
    assert grams("") == []
    three = text_functions.ngrams(text_functions.tokens(F.lit("aa bb cc dd")), 2, 3)
    assert value(spark, three) == ["aa bb", "bb cc", "cc dd", "aa bb cc", "bb cc dd"]


def test_compose_keeps_the_separator(spark):
    none = F.lit(None).cast("string")
    assert value(spark, text_functions.compose(none, F.lit("body"))) == " body"
    assert value(spark, text_functions.compose(F.lit("d"), F.lit("body"), 2)) == "d bo"


def test_derivation_lines(spark):
    text = F.lit("  Forked from x  \nforklift\r\ncredit to y\nplain")
    assert value(spark, text_functions.derivation_lines(text)) == ["Forked from x", "credit to y"]


def test_naming_words(spark):
    found = value(spark, text_functions.naming_words(F.lit("Big-Words"), F.lit("<b>tag</b> see [x](y) `Code`")))
    assert [w for w in found if w] == ["bigwords", "tag", "see", "code"]


def test_titles(spark):
    assert value(spark, text_functions.joined_title(words("ab", "cd", "ef", "gh"))) == "Ab / Cd / Ef"
    assert value(spark, text_functions.title_from_name(F.lit("@s/pi-web-search"))) == "Web Search"
