"""Connected components of an undirected graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import discard, stored


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on (u, v) with u > v."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    large = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
    return small.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: (a, b) of one orderable type. (node, component) of every node with an edge to another.

    The component is its least node. Each step keeps the components and ends in a star per
    component; hubs are reduced before they are shuffled (min) or joined, where Spark splits
    them. Every step is written to the shared folder, so that lineage stays short. Nulls and
    loops are left out; no edges give no rows.
    """
    now = stored(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        before, now = now, stored(_stars(now), "stars")
        discard(before)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        mark = seen
    raise RuntimeError(f"components did not settle in {rounds} rounds")
