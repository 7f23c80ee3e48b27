"""Connected components of a graph given as edges, as a loop of joins and grouped minima.

Large-star and small-star steps alternate until nothing changes: every node's larger (then smaller)
neighbours are hooked to the smallest neighbour. A node with many neighbours is only ever grouped
with a minimum, which combines before the shuffle, and joined, where Spark can split a skewed side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from emberwatch.plans.lineage import pin


def _hook(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        # a > b holds for every edge, so a's neighbours here are all smaller
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        near = edges.join(low, "a")
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return out.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b); component is its smallest node.

    Nulls and loops are ignored: a node that only has those is not listed.
    """
    now = pin(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (state := _state(now)) != before:
        before = state
        if not state[0]:
            break
        now = pin(_hook(_hook(now, True), False))
    # now every edge leads from a node to the smallest node of its component
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
