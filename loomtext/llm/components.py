"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is two aggregations and a join of tables that the cluster holds; lineage is cut after each
round. The number of rounds grows with the logarithm of the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.runtime import cut, hot_join


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = _both_ways(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("v").alias("n"))
    return hot_join(both.where("v > u"), least, "u", "n", 2 * total).select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("v").alias("n"))
    moved = hot_join(down, least, "u", "n", total).where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long -> (node, root): for each node of an edge the least node it reaches. Loops, repeated
    edges and an empty table are allowed; an edge with a null end is no edge. A star of any size is spread over tasks."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    signature = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == signature or now[0] == 0:
            break
        signature = now
        larger = cut(_large_star(edges, now[0]).where("a <> b").distinct())
        edges = cut(_small_star(larger, now[0]).where("a <> b").distinct())
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
