"""Joins by a predicate without an equality, and joins on keys that may hold a great part of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def predicate_join(left: DataFrame, small: DataFrame, on: Column, most: int = 50_000) -> DataFrame:
    """``left`` with the rows of ``small`` that satisfy ``on``. The small side is counted first; it is broadcast as a whole
    up to ``most`` rows, and beyond that in blocks of about so many, each met by all rows of ``left``."""
    blocks = max(1, -(-small.count() // most))
    if blocks == 1:
        return left.join(F.broadcast(small), on)
    parts = (small.where(F.pmod(F.xxhash64(*small.columns), F.lit(blocks)) == i) for i in range(blocks))
    return reduce(DataFrame.unionByName, (left.join(F.broadcast(p), on) for p in parts))


def salted_join(left: DataFrame, right: DataFrame, on: str, share: int = 1000, least: int = 100_000, counts: DataFrame | None = None) -> DataFrame:
    """Inner join of two tables that both may repeat keys. A key's rows in ``left`` are counted first; keys with over
    1/``share`` of them (and over ``least``), fewer than ``share``, are split into parts of about that size, each of which
    meets a copy of the key's rows in ``right``. So no task gets all rows of a key; null keys are dropped. ``counts(on, __n)``
    saves the counting where the caller has done it. ``left`` is read twice, so it should be stored."""
    counts = counts if counts is not None else left.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("__n"))
    limit = max(least, (counts.agg(F.sum("__n")).first()[0] or 0) // share)
    hot = F.broadcast(counts.where(F.col("__n") > limit).select(on, F.ceil(F.col("__n") / limit).cast("int").alias("__parts")))
    mine = left.join(hot, on, "left").withColumn("__salt", F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*left.columns), F.col("__parts")).cast("int")))
    theirs = right.join(hot, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)))
    return mine.drop("__parts").join(theirs.drop("__parts"), [on, "__salt"]).drop("__salt")


def join_counted(rows: DataFrame, table: DataFrame, on: str | list[str], count: str, share: int = 1000, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each key (of one or more columns) and says in ``count`` how many
    rows hold it.

    Keys with over 1/``share`` of all rows, fewer than ``share`` of them, are broadcast, so that their rows stay where they
    are; the others are joined by a shuffle, in which no key has more than that part of the rows. With ``how="left"`` rows
    whose key is not in ``table`` stay."""
    total = table.agg(F.sum(count)).first()[0] or 0
    often = F.col(count) * share > total
    hot, cold = table.where(often).drop(count), table.where(~often).drop(count)
    rest = rows.join(F.broadcast(hot.select(on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(rest.join(cold, on, how))


def left_join_present(rows: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Left join of ``rows`` with a ``table`` of one row for each key, in which rows with a null key stay where they are
    instead of meeting in one task. ``rows`` is read twice."""
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema.fields if f.name != on]
    return rows.where(F.col(on).isNotNull()).join(table, on, "left").unionByName(rows.where(F.col(on).isNull()).select("*", *empty))
