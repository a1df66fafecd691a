"""The cleaning pipeline: stages over ``documents``, each reading what the one before has written."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontaminate, minhash, quality, secrets, sentencepiece_bpe
from corpusloom.llm._storage import materialise, scratch
from corpusloom.sources.files import shared_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. A null or empty text has no words and goes; a null language is judged by
    the base rules alone; repeated rows are judged alike."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity of 0.8 or more): the one with the
    smallest id, in all its rows if they repeat it. Rows without an id, and texts without words, are in no group and stay."""
    return minhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that copy an item of ``benchmark`` go. Rows without an id or a text stay; so do all where ``benchmark`` is
    empty."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; what looks like a secret is replaced by a marker in their texts. Null texts stay null; repeated
    rows are changed alike."""
    return secrets.redact(docs)


def sentencepiece_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of tokens of every document, and digests of its ids and of the text that they decode to. A null text is
    empty; every row has one row."""
    return sentencepiece_bpe.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("sentencepiece", sentencepiece_round_trip),
]

#: Near-duplicate groups, spaced seeds and byte-pair encoding have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's output is written as Parquet and read again by the next, and what a stage
    needed besides is deleted then. Nulls, empty texts, repeated rows and further columns pass as the stages say; an empty
    table gives an empty table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        with scratch(spark):
            docs = materialise(stage(spark, docs, sf_dir), name, path)
    return STAGES[-1][1](spark, docs, sf_dir)
