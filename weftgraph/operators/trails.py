"""Variable-length expansion: all trails (no edge twice) from given start nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import refuse
from ..sources.scratch import settled

#: Longer ranges are expanded level by level with checkpoints instead of one plan.
UNROLLED = 3


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """``id, a, b``: edges as walked; either way for 'both' (a loop once)."""
    out = edges.select("id", F.col("src").alias("a"), F.col("dst").alias("b"))
    back = edges.select("id", F.col("dst").alias("a"), F.col("src").alias("b"))
    if direction == "out":
        return out
    return back if direction == "in" else out.union(back.where("a <> b"))


def within_budget(level: DataFrame, budget: int | None) -> None:
    """Refuse a level of more rows than the query may hold."""
    if budget is not None and level.limit(budget + 1).count() > budget:
        raise refuse(f"a search of more than {budget} states", "budget")


def leading_to(walked: DataFrame, ends: DataFrame, hops: int) -> list[DataFrame]:
    """Distinct nodes from which an end is at most 0, 1, ... ``hops`` edges away."""
    out = [settled(ends.select("id").distinct())]
    for _ in range(hops):
        before = walked.join(out[-1].withColumnRenamed("id", "b"), "b", "left_semi").select(F.col("a").alias("id"))
        out.append(settled(out[-1].union(before).distinct()))
    return out


def trails(edges: DataFrame, starts: DataFrame, direction: str, low: int, high: int, ends: DataFrame | None = None, budget: int | None = None) -> DataFrame:
    """``t_start, t_end, t_edges, t_nodes`` of trails of ``low`` to ``high`` edges.

    ``starts`` has the one column ``id``.  Nodes may repeat, edges may not; a
    loop is an edge like any other.  With ``ends`` only trails to those are
    wanted: long ranges go on only where one can still be reached.  With a
    ``budget`` a level of more trails is refused.
    """
    walked = oriented(edges, direction)
    level = starts.select(
        F.col("id").alias("t_start"), F.col("id").alias("t_end"), F.array().cast("array<bigint>").alias("t_edges"), F.array("id").cast("array<bigint>").alias("t_nodes")
    )
    out = level if low == 0 else None
    stepwise = high > UNROLLED or budget is not None
    # Beyond the depth of the range a set only grows; its last one serves.
    near = leading_to(walked, ends, min(high - 1, UNROLLED)) if ends is not None and high > UNROLLED else None
    for hop in range(1, high + 1):
        joined = level.join(walked, F.col("t_end") == F.col("a")).where(~F.array_contains("t_edges", F.col("id")))
        level = joined.select("t_start", F.col("b").alias("t_end"), F.array_append("t_edges", F.col("id")).alias("t_edges"), F.array_append("t_nodes", F.col("b")).alias("t_nodes"))
        if near is not None and high - hop < len(near):
            level = level.join(near[high - hop].withColumnRenamed("id", "t_end"), "t_end", "left_semi").select("t_start", "t_end", "t_edges", "t_nodes")
        if stepwise:
            level = settled(level)
            within_budget(level, budget)
            if level.isEmpty():
                break
        if hop >= low:
            out = level if out is None else out.union(level)
    return level.where(F.lit(False)) if out is None else out
