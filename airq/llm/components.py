"""Connected components of a distributed edge list, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airq.llm.shared import written


def _to_least(edges: DataFrame, nodes: DataFrame, larger_only: bool) -> DataFrame:
    """Link the neighbours of every node to the least node around it."""
    least = nodes.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    linked = edges.join(written(least), "u")
    if larger_only:
        linked = linked.filter("v > u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``u, v`` for every node ``u`` that has an edge: ``v`` is the least node of its component.

    ``edges`` has columns ``u, v`` (longs) in either direction; self-links and
    repeats are harmless. Large stars and small stars alternate until nothing
    changes, about a logarithm of the longest path. Each step is a minimum that
    is combined before its shuffle, and a join with written tables on both sides, so
    that the rows of a hub can be split. Steps are written to the shared folder.
    """
    edges = written(edges.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(_to_least(both, both, True).distinct())
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = written(down.groupBy("u").agg(F.min("v").alias("m")))
        small = down.join(least, "u")
        edges = written(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == state:
            return edges
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
