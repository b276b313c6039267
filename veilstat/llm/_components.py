"""Connected components of an edge table by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstat.llm._spark import checkpointed, parts_for


def _starred(current: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, or only larger ones: then each component is a star."""
    ends = current.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(current.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of (a, b) edges; label is the component's smallest node.

    Each step replaces a node's edges by edges to its smallest neighbour, found by a partial minimum and an equi-join
    that Spark can split where a node has many edges, until they are a star per component. What a shuffle reads has as
    many partitions as the rows need, so a step over few edges leaves few files, whatever `spark.sql.shuffle.partitions`.
    """
    current = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    parts = parts_for(current.count())
    current = current.coalesce(parts)
    while not _starred(current):
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(least.filter("m < u").select("u", F.col("m").alias("v"))).filter("u <> v").coalesce(parts).distinct().coalesce(parts)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        current = checkpointed(small.filter("u <> v").coalesce(parts).distinct().coalesce(parts))
    return current.select(F.col("u").alias("node"), F.col("v").alias("label")).union(current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct().coalesce(parts))
