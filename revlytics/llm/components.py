"""Connected components of a graph given by its edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlytics.llm.common import discard, stage


def _settled(edges: DataFrame) -> bool:
    """Whether edges (u, v) are stars already: no node is u twice, or u and v."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    return ends.groupBy("node").agg(F.sum("up").alias("n"), F.min("up").alias("least")).where("n > 1 or n = 1 and least = 0").count() == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v); root is the least node reachable.

    Large-star links each node's larger neighbours to its least one, small-star its smaller ones;
    both keep components. Every round is written to the shared scratch folder, and there are rounds until
    only stars are left. A hub's minimum is pre-aggregated; its edges, two numbers each, may meet in one task of the join on it.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stage(edges, "edges")
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, stage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        discard(old, large)
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
