"""The text pipeline: language, near copies, benchmark passages, personal data, tokens.

Each stage works on all that the stage before it kept, which is written as Parquet in the shared folder and read again.
Rows may have nulls in any column; a null text has no language and goes in the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from milepost.llm import op3_sentencepiece, op4_setsketch, op5_pii, op6_spaced_seeds, op7_language
from milepost.llm.common import ship, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, whose language cannot be told, and names the language of those that have none."""
    ship(spark)
    return op7_language.with_language(docs, op7_language.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near copies: shingles of five words, similarity 0.8."""
    ship(spark)
    return op4_setsketch.without_copies(docs, op4_setsketch.Rule(words=5, percent=80))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, exactly or with words exchanged."""
    ship(spark)
    return op6_spaced_seeds.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets."""
    ship(spark)
    return op5_pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, with the number of them and whether decoding gives the text back."""
    ship(spark)
    marked = docs.select("doc_id", "lang", "source", "n_chars", F.xxhash64("text").alias("before"), "text")
    found = op3_sentencepiece.tokenize(marked)
    return found.select(
        "doc_id", "lang", "source", "n_chars", "ids", F.size("ids").cast("long").alias("n_ids"),
        (F.xxhash64("decoded") == F.col("before")).alias("round_trip"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: Suffix automata, sketches, bootstrapping and Viterbi search have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
