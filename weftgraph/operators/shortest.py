"""Shortest paths by level-synchronous breadth-first search over DataFrames.

Distances are found forward from the smaller end; paths are then read
backward along edges whose distances differ by one, so no path needs a check
for repeats.  Levels are checkpointed: a plan never holds more than one.

Edges are the large table: a level that fits in ``LIGHT`` bytes is sent to
them, so they are read but not shuffled; only larger levels are shuffled with
them.

A state is kept for each root and node, and roots that have met all ends drop
out.  For the least length overall all roots search as one, so there is a
state for each node alone, unless an end is a start too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settled
from .trails import oriented, within_budget

MOST_HOPS = 127
#: Bytes at most of a level that is broadcast.
LIGHT = 8 << 20


def light(df: DataFrame, rows: int, words: int) -> DataFrame:
    """``df`` of so many rows and words of eight bytes each, to be broadcast if it is small."""
    return F.broadcast(df) if rows * words * 8 <= LIGHT else df


def shortest_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, direction: str, high: int, mode: str, budget: int | None = None) -> DataFrame:
    """``t_start, t_end, t_edges, t_nodes`` of shortest paths of at most ``high`` edges.

    ``mode``: 'one' path for each connected pair (the least by edge ids from
    its end), all of each 'pair', or those of the 'overall' least length.
    ``starts`` and ``ends`` have the one column ``id``; pairs of a node with
    itself are left out.  Parallel edges give paths of their own.  With a
    ``budget`` a level of more states is refused.
    """
    high = min(high, MOST_HOPS)
    starts, ends = settled(starts.distinct()), settled(ends.distinct())
    n_starts, n_ends = starts.count(), ends.count()
    turned = n_ends < n_starts
    roots, goals = (ends, starts) if turned else (starts, ends)
    walked = oriented(edges, {"out": "in", "in": "out"}.get(direction, direction) if turned else direction)
    goals = goals.select(F.col("id").alias("goal"))

    both = starts.join(ends, "id").count()
    as_one = mode == "overall" and both == 0
    visited = roots.select((F.lit(0).cast("long") if as_one else F.col("id")).alias("root"), F.col("id").alias("node"), F.lit(0).alias("dist"))
    frontier = visited
    apart = (F.col("node") == F.col("goal")) & (F.lit(as_one) | (F.col("root") != F.col("goal")))
    n_goals = n_starts if turned else n_ends
    wanted = n_goals if as_one else n_starts * n_ends - both
    found, met = 0, None
    n_roots = n_ends if turned else n_starts
    # Rows of the level and of all levels.
    n_level = n_visited = n_roots
    for hop in range(1, high + 1):
        reached = light(frontier, n_level, 3).join(walked, F.col("node") == F.col("a")).select("root", F.col("b").alias("node")).distinct()
        frontier = settled(reached.join(visited, ["root", "node"], "left_anti").withColumn("dist", F.lit(hop)))
        within_budget(frontier, budget)
        n_level = frontier.count()
        n_visited += n_level
        hits = frontier.join(goals, apart, "left_semi").groupBy("root").agg(F.count("*").alias("n"))
        met = settled(hits if met is None else met.union(hits).groupBy("root").agg(F.sum("n").alias("n")))
        now = met.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        visited = visited.union(frontier)
        if now >= wanted or mode == "overall" and now or now == found and not n_level:
            break
        found = now
        if not as_one and found:
            # A root that is an end itself has one end less to meet; it goes on, at worst without need.
            frontier = frontier.join(met.where(F.col("n") >= n_goals).select("root"), "root", "left_anti")

    pairs = visited.join(goals, apart, "left_semi")
    if mode == "overall":
        pairs = _least(pairs)
    rows = settled(
        pairs.select("root", F.col("node").alias("end"), "node", "dist", F.array().cast("array<bigint>").alias("path_edges"), F.array("node").cast("array<bigint>").alias("path_nodes"))
    )
    before = light(visited.select(F.col("root").alias("r"), F.col("node").alias("n"), F.col("dist").alias("d")), n_visited, 3)
    if mode == "one":
        # One predecessor of each reached node is enough: the least edge.
        steps = before.join(walked, F.col("n") == F.col("a")).join(light(visited, n_visited, 3), (F.col("r") == F.col("root")) & (F.col("b") == F.col("node")) & (F.col("d") + 1 == F.col("dist")))
        steps = settled(steps.groupBy("root", "b").agg(F.min(F.struct("id", "a")).alias("by")).select(F.col("root").alias("r"), "b", F.col("by.id").alias("id"), F.col("by.a").alias("a")))
    out = None
    deepest = rows.agg(F.max("dist")).first()[0] or 0
    for step in range(deepest):
        rows = light(rows, rows.count(), 5 + 2 * step)
        if mode == "one":
            ahead = rows.join(steps, (F.col("root") == F.col("r")) & (F.col("node") == F.col("b")))
        else:
            ahead = rows.join(walked, F.col("node") == F.col("b")).join(before, (F.col("root") == F.col("r")) & (F.col("a") == F.col("n")) & (F.col("dist") - 1 == F.col("d")))
        rows = settled(
            ahead.select("root", "end", F.col("a").alias("node"), (F.col("dist") - 1).alias("dist"), F.concat(F.array("id"), "path_edges").alias("path_edges"), F.concat(F.array("a"), "path_nodes").alias("path_nodes"))
        )
        done = rows.where("dist = 0")
        out = done if out is None else out.union(done)
        rows = rows.where("dist > 0")
    out = rows.where(F.lit(False)) if out is None else out
    flip = F.reverse if turned else (lambda c: F.col(c))
    root = F.element_at("path_nodes", 1)
    first, last = (F.col("end"), root) if turned else (root, F.col("end"))
    return out.select(first.alias("t_start"), last.alias("t_end"), flip("path_edges").alias("t_edges"), flip("path_nodes").alias("t_nodes"))


def _least(pairs: DataFrame) -> DataFrame:
    """Only the pairs at the least distance of all."""
    least = pairs.agg(F.min("dist")).first()[0]
    return pairs.where(F.lit(False)) if least is None else pairs.where(F.col("dist") == least)
