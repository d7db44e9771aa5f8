"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is two shuffles of (node, node) rows; the steps' number grows with the logarithm of the longest path.
No step gathers a node's neighbours in a task: minima are aggregated before the shuffle, and the joins that follow
are ordinary ones, whose large keys AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.cluster import drop, staged


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """edges: (u, v), u > v. Large: each neighbour above u goes to u's least one; small: each below does."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if larger:
        linked = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = both.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return linked.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: (u bigint, v bigint) in any order. Returns (node, root) for every node with an edge to another; root: the component's least node."""
    now = staged(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        new = staged(_stars(_stars(now, True), False), "edges")
        drop(now)
        now, before, state = new, state, _state(new)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
