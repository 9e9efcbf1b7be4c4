"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a grouping with partial aggregation and one join on the same key; nothing passes through the driver but
two numbers that tell whether the step changed an edge. A node with very many edges is only ever a key of partial
aggregates and of a join whose large partitions adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, written


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = around.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    to = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return to.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v), any direction, repeats and loops allowed, rows with a null ignored -> (node, component), where
    component is the smallest node reachable. Nodes without an edge to another node are not in the result.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = written(edges, "edges")
    before = _fingerprint(edges)
    while True:
        last, edges = edges, written(_star(_star(edges, large=True), large=False), "edges")
        discard(last)
        now = _fingerprint(edges)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
            ).distinct()
        before = now
