"""Usage tracking and promotion (U operators)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact(column: str) -> Column:
    """Numbers of six places as decimals, whose sum is the same in any order."""
    return F.col(column).cast("decimal(18,6)")


def upload_stats(uploads: DataFrame) -> DataFrame:
    """``(hash, name, thread_id, ts)``."""
    return uploads.groupBy("hash").agg(F.count("*").alias("uploads"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.max_by("name", "ts").alias("name"), F.count_distinct("thread_id").alias("threads"))


def auto_promote(stats: DataFrame, promoted: DataFrame, threshold: int = 3) -> DataFrame:
    """U2."""
    return stats.where(F.col("uploads") >= threshold).join(promoted.select("hash").distinct(), "hash", "left_anti")


def chunk_usage(uses: DataFrame) -> DataFrame:
    """``(thread_id, file_id, chunk_id, score)``: summed relevance and number of uses of every chunk, with its file's."""
    by = uses.groupBy("thread_id", "file_id", "chunk_id").agg(F.round(F.sum("score"), 6).alias("score"), F.count("*").alias("uses"))
    return by.withColumn("query_count", F.sum("uses").over(Window.partitionBy("thread_id", "file_id")))


def pareto_chunks(usage: DataFrame, top: float = 0.2, min_queries: int = 5) -> DataFrame:
    """U4: the top share of the chunks of each eligible file, with their share of the file's score."""
    file = Window.partitionBy("thread_id", "file_id")
    df = usage.where(F.col("query_count") >= min_queries).withColumns({"n": F.count("*").over(file), "total": F.sum(exact("score")).over(file).cast("double"), "place": F.row_number().over(file.orderBy(F.desc("score"), "chunk_id"))})
    df = df.where(F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("n") * top + 1e-9)))
    return df.withColumn("share", F.round(F.when(F.col("total") > 0, F.col("score") / F.col("total")).otherwise(0.0), 6)).drop("total")


def promote(chunks: DataFrame, chosen: DataFrame | None, tenant: str = "default") -> DataFrame:
    """Chunks of ``temp_<thread>`` as rows of the default tenant: all, or the chosen ``(thread_id, chunk_id)``."""
    temp = chunks.where(F.col("tenant").startswith("temp_"))
    if chosen is not None:
        keys = chosen.select(F.concat(F.lit("temp_"), "thread_id").alias("tenant"), "chunk_id")
        temp = temp.join(keys, ["tenant", "chunk_id"], "left_semi")
    return temp.withColumns({"promoted_from": F.col("tenant"), "tenant": F.lit(tenant)})


def promotable_files(pareto: DataFrame) -> DataFrame:
    """U6."""
    by = pareto.groupBy("thread_id", "file_id").agg(F.count("*").alias("top"), F.max("n").alias("n"), F.max("query_count").alias("q"), F.round(F.sum(exact("share")) * 100, 1).cast("double").alias("pct"))
    return by.select("thread_id", "file_id", F.format_string("%d of %d chunks carry %.1f%% of the score in %d uses", "top", "n", "pct", "q").alias("reason"))


def tracking_stats(uploads: DataFrame, temporal: DataFrame, now: str) -> DataFrame:
    """Unique files, active temporal files, promoted files."""
    t = F.lit(now).cast("timestamp")
    one = uploads.agg(F.count_distinct("hash").alias("unique_files"))
    two = temporal.agg(F.count_if(F.col("expires_at") > t).alias("active"), F.count_if("promoted").alias("promoted"))
    return one.join(F.broadcast(two))


def artifact_stats(files: DataFrame, now: str, ttl: str) -> DataFrame:
    """U8: ``(thread_id, path, size, mtime)``: of each thread files, MB, files past their time, and whether none is left."""
    old = F.col("mtime") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {ttl}")
    by = files.groupBy("thread_id").agg(F.count("*").alias("files"), F.round(F.sum("size") / 1048576, 6).alias("mb"), F.count_if(old).alias("expired"))
    return by.withColumn("left_empty", F.col("expired") == F.col("files"))
