"""The registered queries of this subpackage, one for each operator, over whole tables; ``SQL`` has their oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import collision_search, decontaminate, html_wrapper, importance, licenses, minhash, oracles, quality, secrets, sentencepiece_bpe, superkmer, token_alignment, token_blocks, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=2, percent=80)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(_table(spark, sf_dir, "pages"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract(_table(spark, sf_dir, "pages"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).withColumn("notices", F.array_join("notices", ","))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_blocks.tokenize_to_blocks(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_blocks.read_tokens(spark, path, ids=False)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmer.remove_repeats(_table(spark, sf_dir, "documents"), k=13, digest=True)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality.judge(_table(spark, sf_dir, "documents")).select("doc_id", *(F.col(f"q.{c}").alias(c) for c in counts), "base_failed", "kept")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return collision_search.search(vectors.where(F.col("vec_id") % 100 == 0), vectors)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


_ALL = (op1_minhash_neardup, op2_sentencepiece, op3_decontamination, op4_warc, op5_html_extraction, op6_license_scan, op7_token_output, op8_substring_dedup, op9_secret_scan, op10_quality_rules, op11_token_alignment, op12_collision_search, op13_importance_resampling)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

SQL: dict[str, str] = oracles.SQL
