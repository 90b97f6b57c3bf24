"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.common import stage, unstage


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Every neighbour of u (larger ones, or smaller ones with u itself) is linked to the least of them and u."""
    both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else \
        pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy(F.col("u").alias("c")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    out = both.join(least, F.col("u") == F.col("c"))
    out = (out.filter(F.col("v") > F.col("u")) if large else out).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.union(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (u, v); the component is its least node.

    Rows of one node are never gathered: each step is an aggregate and a join,
    whose large partitions Spark splits.  Steps repeat until the links are a
    star around each component's least node, which doubles the reach each time.
    The first step reads ``links`` several times; the result reads a table of :func:`~cohortkit.llm.common.stage`.
    """
    before, edges = None, links.filter(F.col("u") != F.col("v"))
    while True:
        edges = stage(_star(_star(edges, True), False).distinct(), "components")
        if before is not None:
            unstage(before)
        before = edges
        # Small-star leaves each node with one lesser neighbour unless it still joins several; done when none of
        # those neighbours has a lesser one itself and no node has two.
        once = edges.groupBy("u").agg(F.count("*").alias("k"))
        roots = edges.select(F.col("v").alias("u")).distinct().withColumn("root", F.lit(1))
        open_ = once.join(roots, "u", "left").filter((F.col("k") > 1) | F.col("root").isNotNull())
        if open_.isEmpty():
            break
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select("v", "v").distinct())
    out._staged_at = edges._staged_at
    return out
