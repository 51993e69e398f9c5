"""Operators over whole texts against plain Python."""

import collections
import hashlib
import math
import random
import re

import pytest
import tokenizers
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from shelfmark.llm import bpe_stream, html_density, license_scan, quality, simhash, token_counts, url_filter
from shelfmark.llm.queries import QUERIES, tokenizer
from tests.llm import data


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return data.frame(spark).cache()


def same(found, wanted):
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted(map(tuple, found), key=key) == sorted(wanted, key=key)


# BPE

WORD = tokenizer("word_bpe_49k.json")
BYTE = tokenizer("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def model():
    return bpe_stream.Model(bpe_stream.read_source(WORD))


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(WORD)


def test_encode_documents(docs, library):
    wanted = []
    for doc_id, text, *_ in data.rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        wanted.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(decoded)))
    same(bpe_stream.encode_documents(docs, WORD).collect(), wanted)


PARTS = ["'s", "'", "t", "re", "ve", " ", "\n", "a", "the", "é", "e\u0301", "Σ", "İ", "1", "23", "!", "...", "<|endoftext|>",
         "<|endof", "\u3000", "漢字", "\u1100", "\u1161", "😀", "\x85", "\x1c"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40), st.lists(st.integers(0, 80), max_size=8))
def test_pieces_do_not_matter(model, library, parts, cuts):
    text = "".join(parts)
    ids = library.encode(text, add_special_tokens=False).ids
    assert bpe_stream.encode(model, text, sorted(min(c, len(text)) for c in cuts)) == ids
    assert bpe_stream.decode(model, ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("letters", ["ab", "thein", "abcdefghijklmnopqrstuvwxyz", "!?", "é漢ab"])
def test_long_runs_in_constant_memory(model, library, letters):
    r = random.Random(letters)
    text = "".join(r.choice(letters) for _ in range(40_000))
    encoder, ids, most = bpe_stream.Encoder(model), [], 0
    for at in range(0, len(text), 500):
        for part, _ in encoder.feed(text[at : at + 500]):
            ids += map(int, part.split())
        most = max(most, len(encoder.raw) + len(encoder.open) + len(encoder.inside or ()))
    for part, _ in encoder.finish():
        ids += map(int, part.split())
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert most <= 2 * (model.lookahead + model.longest) + 8_000


def test_lookahead_of_a_chain():
    # ab <- bc <- cd: whether ab merges is told by cd, which ends two symbols behind it
    merges = [(tuple("cd"), 1), (tuple("bc"), 1), (tuple("ab"), 1)]
    assert bpe_stream.sufficient_lookahead(merges) == 4


def test_a_stretch_is_split_when_it_is_first_met(model, monkeypatch):
    plain, split = model.plain(), []

    class Counted:
        def findall(self, text, *span):
            split.append(text)
            return model.split_pattern.findall(text, *span)

    library = tokenizers.Tokenizer.from_file(WORD)
    monkeypatch.setattr(model, "split_pattern", plain.pattern, raising=False)
    plain.pattern = Counted()
    text = "don't stop, (stop) don't, stop, don't \x1c stop,\x1f don't straße\u2003stop, x" + " stop, don't" * 500 + "'s ''re "
    for given_text in (text.replace("\x1c", "").replace("\x1f", ""), text):
        assert bpe_stream.encode(plain, given_text) == library.encode(given_text, add_special_tokens=False).ids
    splits = [s for s in split if s]
    assert len([s for s in splits if s == "stop,"]) <= 2 and len(splits) < 60


@given(st.text(st.sampled_from("theanorßé'srv.,-2 "), max_size=80))
@settings(max_examples=150, deadline=None)
def test_short_words_merge_like_long_ones(model, text):
    for word in model.pattern.findall(text):
        assert model.word(word) == model.told(model.merge(model.symbols_of(word, True)))


def test_rows_round_trip(docs):
    ids = bpe_stream.encode_rows(docs.withColumn("TOKEN_IDS", F.lit(1)), WORD)
    back = {r["doc_id"]: r["decoded"] for r in bpe_stream.decode_rows(ids, WORD).collect()}
    assert back[3] == "one</w>" and back[0] == ""


def test_token_counts(docs):
    library = tokenizers.Tokenizer.from_file(BYTE)
    wanted = [
        (i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in data.rows()
    ]
    same(token_counts.token_counts(docs, BYTE, buckets=7).collect(), wanted)


def test_token_counts_with_full_tables(docs, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHED", 3)
    pieces = token_counts.Pieces(bpe_stream.read_source(BYTE))
    words = [" zebrafishes", " qwxzy", "ttttt", " zebrafishes", "ab12"]
    assert pieces.many(words) == [len(pieces.tokenizer.encode(w).ids) for w in words]


# Quality


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    marked = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(marked)


def test_quality_measures(docs):
    path = tokenizer("piece_bpe_32k.model")
    found = quality.measures(docs, path).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    )
    wanted = []
    for doc_id, text, *_ in data.rows():
        m = plain_measures(text or "")
        wanted.append((doc_id, *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    same(found.collect(), wanted)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=30), st.booleans())
def test_repeated_words(words, wide):
    import numpy as np

    codes = np.array([ord(w) - 97 for w in words], np.int64)
    # many distinct words take the way that numbers the windows anew
    distinct = 1 << 31 if wide else 3
    assert quality.repeated_words(codes, distinct) == plain_measures(" ".join(words))[4]


def test_fertility_against_the_library():
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    with open(path, "rb") as file:
        fertility = quality.Fertility(file.read())
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    text = "the cat and the 漢 hat \U0001f9ff and"
    tokens = [i for w in text.split() for i in library.encode(w)]
    counts = collections.Counter(text.split())
    import numpy as np

    total, in_bytes, entropy = fertility.measure(list(counts), np.array(list(counts.values())))
    shares = np.array(list(collections.Counter(tokens).values())) / len(tokens)
    assert (total, in_bytes) == (len(tokens), sum(library.is_byte(i) for i in tokens))
    assert entropy == pytest.approx(float(-(shares * np.log2(shares)).sum()))


def test_quality_keeps_prose_and_rejects_noise(spark):
    r = random.Random(5)
    noise = " ".join("".join(chr(r.randrange(0x10300, 0x10340)) for _ in range(9)) for _ in range(200))
    few = " ".join(r.choice(["buy", "now", "x"]) for _ in range(7)) + " " + " ".join(f"{a} {b}" for a in "ab" for b in "cd")
    table = data.frame(spark, [(1, data.prose(9, 200), "en", "s", 0), (2, noise, "en", "s", 0), (3, few, "en", "s", 0)])
    kept = quality.keep_good(table, tokenizer("piece_bpe_32k.model"))
    assert kept.columns == table.columns and [r["doc_id"] for r in kept.collect()] == [1]


def test_fitted_bands_tell_low_quality(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    told = QUERIES["op6_fertility"](spark, sf_dir).filter("not base_failed").join(labels, "doc_id").collect()
    low, good = ([r["kept"] for r in told if r["quality"] == q] for q in (0, 1))
    assert low and 2 * sum(low) < len(low) and sum(good) >= 0.95 * len(good)


def test_script():
    assert [quality.script_of(t) for t in ("abc é", "привет", "漢字かな", "", "γεια")] == [
        "latin", "cyrillic", "cjk", "other", "greek"
    ]


# SimHash


def test_edited_texts(docs):
    table = data.rows()
    by_key = collections.defaultdict(list)
    for doc_id, text, *_ in table:
        by_key[doc_id].append(text or "")
    order = sorted(by_key, key=lambda k: (k is not None, k or 0))
    after = {k: min(by_key[n]) for k, n in zip(order, order[1:] + order[:1])}
    wanted = []
    for doc_id, text, *_ in table:
        text = text or ""
        changed = text[: len(text) - len(text) // 4] + after[doc_id][: len(text) // 4]
        wanted.append((doc_id, len(text), sha(changed), f"{simhash.fingerprint_of(text):016x}", f"{simhash.fingerprint_of(changed):016x}"))
    found = simhash.edited(docs)
    same(found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint").collect(), wanted)
    assert found.filter("near_edited < 0 or near_edited > 1 or near_next is null").count() == 0


def test_one_next_document_for_both_columns(spark):
    """Where the next id is there twice, the edited text and the likeness name the same row."""
    first, others = data.prose(1, 60), [data.prose(2, 60), data.prose(3, 60), data.prose(4, 60)]
    rows = [(1, first, "en", "s", 1)] + [(2, t, "en", "s", 1) for t in others]
    found = simhash.edited(data.frame(spark, rows)).filter("doc_id = 1").first()
    quarter = len(first) // 4
    named = [t for t in others if sha(first[: len(first) - quarter] + t[:quarter]) == found["edited_sha256"]]
    same_bits = 64 - (simhash.fingerprint_of(first) ^ simhash.fingerprint_of(named[0])).bit_count()
    assert len(named) == 1 and found["near_next"] == same_bits / 64


def test_blocks_follow_the_number_of_fingerprints():
    assert [simhash.blocks_for(n, 3) for n in (10, 10**7, 10**9, 10**11)] == [5, 5, 6, 7]


def test_block_tables_find_all_within_radius(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1, 1 << 63]
    prints = list(base)
    for value in base:
        for flips in (1, 2, 3, 4):
            changed = value
            for bit in r.sample(range(64), flips):
                changed ^= 1 << bit
            prints.append(changed)
    prints += base[:5]
    table = spark.createDataFrame([(f"{p:016x}",) for p in prints], "fingerprint string")
    queries = spark.createDataFrame([(f"{p:016x}",) for p in base], "fingerprint string")
    counts = collections.Counter(prints)
    wanted = [
        (f"{q:016x}", f"{p:016x}", (p ^ q).bit_count(), counts[p])
        for q in set(base) for p in counts if (p ^ q).bit_count() <= 3
    ]
    same(simhash.within_radius(queries, table).select("query", "found", "distance", "copies").collect(), wanted)


def test_op2_counts_all_within_radius(spark, sf_dir):
    found = QUERIES["op2_simhash"](spark, sf_dir).collect()
    prints = [int(r["fingerprint"], 16) for r in found]
    assert len(found) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r, own in zip(found, prints):
        near = sum((own ^ p).bit_count() <= 3 for p in prints)
        assert r["n_within"] == (near if r["doc_id"] is not None and r["doc_id"] % 100 == 0 else None)


def test_counted_within_with_copies(spark):
    values = [0, 0, 1, 7, 15, 255, 1 << 63, (1 << 64) - 1, (1 << 64) - 1]
    rows = [(None if i == 1 else i, f"{v:016x}") for i, v in enumerate(values * 3)]
    found = simhash.counted_within(spark.createDataFrame(rows, "id long, fingerprint string"), F.col("id") % 2 == 0)
    prints = [int(f, 16) for _, f in rows]
    wanted = [
        (i, f, sum((int(f, 16) ^ p).bit_count() <= 3 for p in prints) if i is not None and i % 2 == 0 else None)
        for i, f in rows
    ]
    same(found.collect(), wanted)


# Licenses


def plain_licenses(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    starts, labels = [], set()
    for t in license_scan.PHRASES:
        phrase = t.text.split()
        for i in range(len(words) - len(phrase) + 1):
            if words[i : i + len(phrase)] == phrase:
                starts.append(i)
                labels.add(t.label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_licenses(docs):
    found = license_scan.licenses(docs.withColumn("label", F.lit("x")).withColumn("_id", F.lit(1)))
    base = found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    same(base.collect(), [(i, *plain_licenses(t or "")) for i, t, *_ in data.rows()])


def test_license_spans_with_changed_words(spark):
    text = "x y Permission is hereby granted, free of any charge, to any person obtaining a copy of this software z"
    far = "permission is granted here and there " + "w " * 50 + "copy of this software"
    table = spark.createDataFrame([(1, text), (2, far)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in license_scan.licenses(table).collect()}
    assert found[1]["labels"] == "mit" and found[1]["n_base"] == 0 and 0.8 <= found[1]["score"] < 1
    assert found[2]["labels"] == "" and found[2]["score"] == 0.0
    spans = license_scan.scan(table, "doc_id", "text").collect()
    assert [(s["first_word"], s["last_word"]) for s in spans] == [(2, 18)]


# URLs

URLS = [
    None, "", "no scheme", "http://Example.NET/en/1", "https://a.example.net/fr/1", "http://example.com/de/", "http://org/fr/x",
    "http://m.x.org/fr/?q", "http://net", "http://badnet/", "http://a.b.example.com/de", "x://y.example.net/en/#f", "://net/a",
    "http://net/?a=://org/fr/", "http://example.net?/en/",
]


def plain_verdict(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [
        (len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best[1] if best else None, best[2] if best else "allow"


def test_urls(spark):
    given_rows = [(i, u) for i, u in enumerate(URLS)] + [(3, URLS[3])]
    table = spark.createDataFrame([(i, u, "extra", 1) for i, u in given_rows], "page_id long, url string, Host string, rule int")
    found = url_filter.verdicts(table, url_filter.rule_table(spark, url_filter.RULES))
    same(found.select("page_id", "host", "path", "rule", "verdict").collect(), [(i, *plain_verdict(u)) for i, u in given_rows])


def test_urls_without_rules(spark):
    table = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
    found = url_filter.verdicts(table, url_filter.rule_table(spark, []), default="block").collect()
    assert [(r["rule"], r["verdict"]) for r in found] == [(None, "block")]


# Pages

PAGES = {
    None: "", "": "", "plain text": "plain text", "<p>a  b\n c</p><p>d&amp;e</p>": "a b c d&e",
    "<script>var a='</p>'</script><style>x</style>": "",
    "<body><nav><a href=x>Home</a></nav><article><header><h1>T</h1></header><p>One <b>t</b>wo.<br>three</p>"
    "<p>Four<p>five</article><footer>f</footer>": "T One two. three Four five",
    "<div class='sidebar'>s</div><div id=main><h1>T</h1><p>Long enough text of a page.</p><p>More text of it.</p>"
    "<form><input><button>Go</button></form><div class=comments><p>first reader comment, quite long</p></div></div>":
        "T Long enough text of a page. More text of it.",
    "<article><p>a</p><aside>b</aside><div class='ad'>buy</div><p>c &lt;x&gt; &eacute;</p></article>": "a c <x> é",
    "<p>unclosed <b>tags <i>here": "unclosed tags here",
}


def test_pages(spark):
    pages = [(i, p) for i, p in enumerate(PAGES)]
    table = spark.createDataFrame([(i, p, "clash") for i, p in pages + pages[:1]], "page_id long, html string, Text string")
    found = html_density.extract(table)
    assert found.columns == ["page_id", "text"]
    same(found.collect(), [(i, PAGES[p]) for i, p in pages + pages[:1]])


def paragraphs(tag: str, sizes: list[int]) -> tuple[str, str]:
    """Paragraphs of given sizes with a letter each, and their text."""
    texts = [" ".join(f"{tag}{i}{'x' * 7}" for _ in range(size // 10)) for i, size in enumerate(sizes)]
    return "".join(f"<p>{t}</p>" for t in texts), " ".join(texts)


LINKS = "<div>" + "".join(f"<a href=/{i}>see also number {i}</a> " for i in range(12)) + "</div>"


@pytest.mark.parametrize("second", [[200] * 5, [200] * 4, [150] * 3, [200]])
@pytest.mark.parametrize("page", ["<body>{0}<{2}>{1}</{2}>", "<body>{3}<div>{0}<h2>More</h2><{2}>{1}</{2}></div>{3}"])
@pytest.mark.parametrize("tag", ["div", "section"])
def test_sections_without_an_article(second, page, tag):
    first, one = paragraphs("a", [200] * 5)
    last, two = paragraphs("b", second)
    middle = " More " if "h2" in page else " "
    html = page.format(f"<{tag}>{first}</{tag}>", last, tag, LINKS)
    assert html_density.main_text(html) == one + middle + two


STORY, STORY_TEXT = paragraphs("s", [200] * 3)
SIDE = "<div class=sidebar><p>by the way</p></div>"


@pytest.mark.parametrize("page", [
    "<article style='overflow:hidden'>{}</article>", "<article title='The hidden valley'>{}</article>",
    "<main data-x=hidden>{}</main>", "<div><p hidden>secret words</p>{}</div>", "<div><p class=x hidden=''>secret</p>{}</div>",
    "<div><p HIDDEN>secret words</p>{}</div>", "<div class='has-sidebar'>{}" + SIDE + "</div>",
    "<div class='page no-sidebar'><div>{}</div></div>", "<div id='nav-open'><div class='with-sidebar'>{}</div></div>",
    "<div class='has-comments'><article>{}</article><div class='comments'><p>" + "well " * 300 + "</p></div></div>",
    "<article>{}</article><div class='comments'><p>" + "well " * 300 + "</p></div>",
])
def test_asides_and_wrappers(page):
    assert html_density.main_text(f"<body>{page.format(STORY)}</body>") == STORY_TEXT


def test_short_sections_with_headings_stay():
    page = (
        "<div><section><h2>A</h2><p>Tiny.</p></section><section><h2>B</h2>" + STORY + "</section>"
        "<section><h2>C</h2><p>Tiny two.</p></section><section><h2>More</h2><a href='x'>Other page</a></section></div>"
    )
    assert html_density.main_text(f"<body>{page}</body>") == f"A Tiny. B {STORY_TEXT} C Tiny two."


def plain_density(tree, whole):
    """Composite text density from its definition, for (name, children) trees."""
    def count(node):
        if isinstance(node, str):
            return len(node), 0, 0, 0
        parts = [count(c) for c in node[1]]
        inside = [sum(p[i] for p in parts) for i in range(4)]
        chars, tags, link_chars, link_tags = inside
        return (chars, tags + 1, chars, 1) if node[0] == "a" else (chars, tags + 1, link_chars, link_tags)

    def inner(node):
        parts = [count(c) for c in node[1]]
        return [sum(p[i] for p in parts) for i in range(4)]

    all_chars, _, all_links, _ = inner(whole)

    def density(node):
        chars, tags, link_chars, link_tags = inner(node)
        if not chars:
            return 0.0
        base = math.log(chars / max(chars - link_chars, 1) * link_chars + all_links / max(all_chars, 1) * chars + math.e)
        ratio = chars / max(link_chars, 1) * max(tags, 1) / max(link_tags, 1)
        return chars / max(tags, 1) * math.log(max(ratio, 1.0), max(base, 1 + 1e-9))

    return density(tree), sum(density(c) for c in tree[1] if not isinstance(c, str))


def tree_of(r, depth):
    children = []
    for _ in range(r.randint(0, 4)):
        if depth and r.random() < 0.6:
            children.append((r.choice(["div", "p", "a", "span", "section"]), tree_of(r, depth - 1)))
        else:
            children.append("".join(r.choice("abcdefg") for _ in range(r.randint(1, 40))))
    return children


@pytest.mark.parametrize("seed", range(12))
def test_densities_by_definition(seed):
    whole = ("body", tree_of(random.Random(seed), 5))

    def built(given, parent):
        node = html_density.Node(given[0], parent)
        node.children = [c if isinstance(c, str) else built(c, node) for c in given[1]]
        return node

    root = built(whole, None)
    html_density.weigh(root)
    todo, sums = [(root, whole)], []
    while todo:
        node, given = todo.pop()
        density, total = plain_density(given, whole)
        assert (node.density, node.total) == (pytest.approx(density), pytest.approx(total))
        sums.append(total)
        todo += zip([c for c in node.children if not isinstance(c, str)], [c for c in given[1] if not isinstance(c, str)])
    found = html_density.article(root)
    best = max(html_density.in_order(root), key=lambda n: n.total)
    assert best.total == pytest.approx(max(sums))
    if best.total:
        up = [best]
        while up[-1].parent is not None:
            up.append(up[-1].parent)
        assert any(node in up for node in found)  # the greatest sum is in the article


def test_hidden_in_a_link():
    assert html_density.main_text(f"<article>{STORY}<p>More <a href='/hidden/x.html'>there</a>.</p></article>") == (
        STORY_TEXT + " More there."
    )


def test_deep_and_long_pages():
    deep = "<div>" * 20_000 + "text" + "</div>" * 20_000
    assert html_density.main_text(deep) == "text"
    long = "<article>" + "<p>some words here</p>" * 20_000 + "</article>"
    assert html_density.main_text(long) == " ".join(["some words here"] * 20_000)
