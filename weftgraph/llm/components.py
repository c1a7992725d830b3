"""Connected components of an edge table, by alternating large and small stars.

Every round is a grouped minimum (combined before its shuffle) and an
equi-join, so a vertex with a third of all edges is dealt out like any other
skewed join key and nothing is gathered on the driver but two sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch

MOST_ROUNDS = 60


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``edges`` (a, b) to (vertex, root): root is the least vertex of the component.

    Vertices that are their own root or without edges are not listed; loops
    and nulls are ignored, repeated edges are harmless.
    """
    state = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = scratch.keep(state, f"{name}-0")
    before = None
    for turn in range(1, MOST_ROUNDS + 1):
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        state = scratch.keep(small.distinct(), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
        sums = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if sums == before:
            break
        before = sums
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return state.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
