"""Corpus pipeline: rules, line dedup, near-duplicate removal, source mix and tokens, as a chain of stages.

Each stage reads the documents that the stage before it wrote, so every decision takes effect on the
whole corpus before the next is made. For every stage: nulls in any column are kept as they are (a null
text counts as empty), a repeated row is a document like any other unless the stage says so, texts may have any
length, columns of any name pass through all stages but the last, and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelfactor.llm import bpe, line_dedup, ngram_join, quality_rules, source_mix, store


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their host's frequent lines; n_chars follows the text.

    Empty and null texts have under 20 words and go. A line at the host's limit stays. Repeated rows stay.
    """
    lean = quality_rules.kept_documents(docs)
    return lean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def apply_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long lines that three or more share; n_chars follows the text.

    No document goes; one that loses all lines has an empty text. Null ids are one document, smaller than all.
    """
    lean = line_dedup.dedup_lines(docs, counts=False)
    return lean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def apply_ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id (null ids last, then by text).

    Texts without words all stay, but rows that repeat an id and its text become one. Pairs at 75 % exactly are near copies.
    """
    return ngram_join.representatives(docs)


def apply_source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: up to three times, or not at all.

    Documents without words are not taken. A null source is a source of its own; ties go by id, then size.
    """
    return source_mix.mixed_documents(docs)


def apply_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document with digests of ids and decoded text: doc_id, n_tokens, ids_sha256, decoded_sha256, ids."""
    return bpe.round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", apply_quality_rules),
    ("line_dedup", apply_line_dedup),
    ("ngram_jaccard_join", apply_ngram_join),
    ("source_mix", apply_source_mix),
    ("bpe", apply_bpe),
]

#: The token stage can't be put into SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again.

    What a stage has written besides its result is deleted when it ends, its result when the next one has.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = store.folder(spark, f"pipeline-{name}")
        with store.scope():
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            store.delete(spark, before)
        before = path
    return docs
