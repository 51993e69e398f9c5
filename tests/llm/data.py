"""Small tables with the cases every operator must handle."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["an", "the", "or", "ti", "sh", "é", "on"]) for _ in range(r.randint(1, 4))) for _ in range(words))


def rows() -> list[tuple]:
    base = prose(1, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    texts = [
        None, "", " ", "one", "One", "a b", "a b c", base, base, near, prose(2, 80), prose(3, 80) + "\n\n" + prose(3, 80),
        "Released under the MIT License.\nGNU general public LICENSE here, cc-by", "\t\n\n x \r\n", LONG,
        "Ünïcödé ΣΑΣ İstanbul 漢字かな 한국어 <|endoftext|> 'S don't 123 ###", base.upper(), "K elvin mit license",
    ]
    out = [(i, t, ("en", "fr", None)[i % 3], ("src0", "src7", None, "odd")[i % 4], len(t or "")) for i, t in enumerate(texts)]
    out.append(out[7])  # a repeated row
    out += [(None, prose(4, 60), "en", "src0", 1), (None, prose(4, 60), "en", "src0", 1)]
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)
