"""Documents through five corpus operators: quality, lines, near-duplicates, mix, tokens.

Each stage reads what its predecessor wrote to the shared folder, works on all of it, and but for
the last returns the columns of ``documents``. ``n_chars`` follows the text where a stage changes
it. ORACLE_SQL is None: the first stage measures a public vocabulary's tokens, which SQL cannot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfmark.llm import bpe_stream, line_dedup, mixing, ngram_join, quality
from shelfmark.llm.queries import domain, tokenizer
from shelfmark.session import stage

ORACLE_SQL = None

# Parameters of the mix: weights of the languages, equal ones elsewhere; the share of all tokens.
WEIGHTS = {"lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}
SHARE = 0.75
SEED = 23


def boxed(docs: DataFrame, *named: str, without: str | None = None) -> DataFrame:
    """All columns in one, and beside it those that an operator reads, so that no names clash."""
    inside = [F.col(f"`{c}`") for c in docs.columns if c != without]
    return docs.select(F.struct(*inside).alias("box"), *[F.col(f"`{c}`") for c in named])


def unboxed(told: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` out of the box, but for those that changed."""
    return told.select(*[changed.get(c, F.col("box").getField(c)).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with the fitted bands of four languages."""
    return quality.keep_good(docs, tokenizer("piece_bpe_32k.model"), bands=quality.FITTED)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten different ones or more have; copies are left to the next stage."""
    told = line_dedup.dedup(boxed(docs, "doc_id", "text", without="text"), distinct_texts=True)
    length = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("box.n_chars"))
    return unboxed(told, docs, text=F.col("text"), n_chars=length)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, a similarity of 0.8."""
    return ngram_join.one_of_each(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A mix of three quarters of the tokens by the target weights, each document once at most."""
    placed = boxed(docs, "doc_id", "lang", "source").withColumn("domain", domain(F.col("source")))
    tokens = mixing.word_tokens(F.col("box.text"))
    mixed = mixing.mix(placed, ["domain", "lang", "source"], WEIGHTS, SHARE, 1, SEED, tokens=tokens)
    return unboxed(mixing.repeated(mixed), docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document, as digests of its ids and of their decoded text."""
    return bpe_stream.encode_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", repeated_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixed_sources),
    ("BPE encoding and decoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written and read again but the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
