"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._storage import materialise
from corpusloom.operators.joins import join_counted


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (greater id first) are stars around their components' smallest ids."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up > 0 AND down > 0").limit(1).count()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` with ids of one type -> ``(node, component)``, the component being its smallest id.

    Only nodes with an edge to another node appear. Self loops, repeated edges, either direction and nulls are
    allowed; an empty table gives an empty table. Each step is two joins on a node id, with minimums combined before
    the shuffle; a node with a great part of all edges is broadcast with its minimum instead. The number of steps grows with
    the logarithm of the size of a component.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialise(edges, "edges")
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "low")
        large = join_counted(both, low, "a", "n").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialise(large, "large")
        low = materialise(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "low")
        small = join_counted(large, low, "a", "n").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialise(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
