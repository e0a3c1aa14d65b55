"""From raw documents to tokens: five stages, each written as Parquet and read again as the next one's documents.

Every stage takes the columns of ``documents`` (and any others, which travel along) and all but the last return them.
Rows with nulls, empty and repeated rows and empty tables are handled as the operators say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import bpe, dedup, langid, mixing, shingles
from tidepanel.llm.common import held_out, new_path
from tidepanel.llm.queries import tokenizer_files

#: A document whose best language has less than this share of its words has no language.
LEAST_SHARE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that have a language; those without a letter or a clear language go."""
    named = langid.identify(docs.select(F.struct("*").alias("row"), "text"), docs.filter(~held_out()))
    return named.filter((F.col("lang_pred") != langid.NO_LANGUAGE) & (F.col("score") >= LEAST_SHARE)).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts."""
    return dedup.exact_dedup(docs).filter("kept").select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that a similarity of 0.8 or more of their five-word shingles links."""
    return shingles.near_copies(docs).filter("kept").select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as the mix takes its words, rounded; documents that it does not take go."""
    mixed = mixing.mix(docs).filter("taken > 0")
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    return mixed.select("row", F.explode(F.array_repeat(F.lit(0), times))).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Columns of ``docs`` with ``n_tokens``, ``ids`` and ``round_trip``: whether decoding gives the text again.

    Columns of these names that ``docs`` has itself give way.
    """
    made = {"n_tokens", "ids", "round_trip"}
    kept = [c for c in docs.columns if c.lower() not in made]
    own = [F.col("text" if c.lower() == "text" else f"row.`{c}`").alias(c) for c in kept]
    path, pattern = tokenizer_files()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept if c.lower() != "text")).alias("row"), "text")  # the text goes through Python once
    both = bpe.steps(rows, bpe.encoding(path, pattern), bpe.decoding(path, pattern))
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return both.select(*own, F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("exact", exact),
    ("near", near),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: SQL cannot tell a language model's decisions; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
