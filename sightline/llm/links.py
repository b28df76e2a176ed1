"""Connected components of a table of links, by joins and counts only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.sources import checkpointed


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` of every node of ``a, b`` links; the component is its smallest node.

    Alternates large-star steps (larger neighbours move to the smallest neighbour) and
    small-star steps (smaller ones do); the links stay as many as they were, and
    every round is written out, so a lost executor costs one round at most.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = checkpointed(links)
    state = None
    for _ in range(max_rounds):
        around = _both_ways(links)
        least = around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
        large = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = large.where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b")
        links = checkpointed(small.union(lower.select("a", F.col("least").alias("b"))).distinct())
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
