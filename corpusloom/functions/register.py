"""Registers the engine's functions for SQL: scalar functions, table functions of the splitters, and an aggregate."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.splitting import cjk_pieces, recursive_pieces

CHUNK = T.StructType([T.StructField("chunk_index", T.IntegerType()), T.StructField("chunk_text", T.StringType())])


@F.udtf(returnType=CHUNK)
class SplitRecursive:
    """T1 as a table function: ``SELECT * FROM split_recursive(text, size, overlap)``, also with LATERAL."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
        yield from enumerate(recursive_pieces(text, size, overlap) if text else [])


@F.udtf(returnType=CHUNK)
class SplitCjk:
    """T3 as a table function."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
        yield from enumerate(cjk_pieces(text, size, overlap) if text else [])


@F.pandas_udf(T.DoubleType())
def harmonic_mean(v: pd.Series) -> float:
    """A grouped aggregate: the harmonic mean of positive values."""
    v = v[v > 0]
    return float(len(v) / (1 / v).sum()) if len(v) else 0.0


#: SQL functions made of SQL: they inline into the plan.
SQL_FUNCTIONS = {
    "estimate_tokens(text STRING) RETURNS INT": r"CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(1, CAST(floor(length(regexp_replace(text, '\\s', '')) / 3) AS INT)) END",
    "content_hash(text STRING) RETURNS STRING": "sha2(text, 256)",
    "score_of(score DOUBLE, distance DOUBLE) RETURNS DOUBLE": "coalesce(score, 1 - distance, 0)",
    "cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 0D)",
}


def register(spark: SparkSession) -> None:
    """Make everything here known to ``spark.sql`` of this session."""
    spark.udtf.register("split_recursive", SplitRecursive)
    spark.udtf.register("split_cjk", SplitCjk)
    spark.udf.register("harmonic_mean", harmonic_mean)
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
