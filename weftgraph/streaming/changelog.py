"""Incremental graphs: an append-only change log merged on read.

A change is a row ``(seq, entity, id, op, src, dst, kind, kinds, properties)``:
the full new state of a node or edge (op ``put``) or a tombstone (``del``).
The newest change of an id wins.  A node's tombstone takes along every edge of
it that was there before; putting the node again doesn't bring them back.
Edges whose ends have not come yet wait in the log; those put to a node that
is gone at a fold are dropped by it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..errors import refuse
from ..model import Graph
from ..sources.documents import free_graph
from ..sources.snapshot import file_of, write_text

_LONG = ("seq", "id", "src", "dst")
CHANGE = StructType(
    [
        StructField(name, LongType() if name in _LONG else ArrayType(StringType()) if name == "kinds" else StringType())
        for name in ("seq", "entity", "id", "op", "src", "dst", "kind", "kinds", "properties")
    ]
)
_NODE = ("id", "kinds", "properties")
_EDGE = ("id", "src", "dst", "kind", "properties")


def _changes(df: DataFrame, seq: int | Column, entity: str, op: str) -> DataFrame:
    number = seq if isinstance(seq, Column) else F.lit(seq)
    fixed = {"seq": number, "entity": F.lit(entity), "op": F.lit(op)}
    return df.select(*((fixed[f.name] if f.name in fixed else F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in CHANGE.fields))


def put_nodes(nodes: DataFrame, seq: int | Column) -> DataFrame:
    return _changes(nodes, seq, "node", "put")


def put_edges(edges: DataFrame, seq: int | Column) -> DataFrame:
    return _changes(edges, seq, "edge", "put")


def delete_nodes(ids: DataFrame, seq: int | Column) -> DataFrame:
    """Tombstones of nodes; edges that are older than one of an end need none of their own."""
    return _changes(ids.select("id"), seq, "node", "del")


def delete_edges(ids: DataFrame, seq: int | Column) -> DataFrame:
    return _changes(ids.select("id"), seq, "edge", "del")


def delete_nodes_by_kinds(nodes: DataFrame, seq: int | Column, include: list[str], exclude: list[str] = ()) -> DataFrame:
    """Tombstones of nodes with any of ``include`` and none of ``exclude``."""
    hit = F.arrays_overlap("kinds", F.array(*map(F.lit, include)))
    if exclude:
        hit = hit & ~F.arrays_overlap("kinds", F.array(*map(F.lit, exclude)))
    return delete_nodes(nodes.where(hit), seq)


def delete_edges_by_kinds(edges: DataFrame, seq: int | Column, kinds: list[str]) -> DataFrame:
    return delete_edges(edges.where(F.col("kind").isin(kinds)), seq)


def wipe(nodes: DataFrame, seq: int | Column) -> DataFrame:
    """Tombstones of all nodes, and with them of all their edges."""
    return delete_nodes(nodes, seq)


def after(log: DataFrame, sequence: int) -> DataFrame:
    """Changes that a base saved at ``sequence`` does not hold yet, for replay on it."""
    return log.where(F.col("seq") > sequence)


def _key(properties: str) -> Column:
    return F.get_json_object(properties, "$.objectid")


def upsert_nodes(nodes: DataFrame, rows: DataFrame, seq: int | Column) -> DataFrame:
    """Changes that merge ``rows(kinds, properties)`` into nodes of equal ``objectid``.

    Property bags merge, new values win; kinds are united; unknown keys become
    new nodes with an id hashed from the key.
    """
    old = nodes.select(_key("properties").alias("k"), F.col("id").alias("old_id"), F.col("kinds").alias("old_kinds"), F.col("properties").alias("old_props"))
    new = rows.select(_key("properties").alias("k"), "kinds", "properties").where("k is not null")
    united = new.groupBy("k").agg(F.array_distinct(F.flatten(F.collect_list("kinds"))).alias("kinds"))
    both = united.join(merged_bags(new, "k"), "k").join(old, "k", "left")
    merged = merge_objects(F.col("old_props"), F.col("properties"))
    kinds = F.array_union(F.coalesce("old_kinds", F.array().cast("array<string>")), "kinds")
    return put_nodes(both.select(F.coalesce("old_id", F.xxhash64("k")).alias("id"), kinds.alias("kinds"), merged.alias("properties")), seq)


def upsert_edges(nodes: DataFrame, edges: DataFrame, rows: DataFrame, seq: int | Column) -> DataFrame:
    """Changes for ``rows(start_key, end_key, kind, properties)``: ends by ``objectid``, one edge for each triple."""
    keys = nodes.select(_key("properties").alias("k"), F.col("id").alias("n"))
    ready = rows.join(keys.withColumnsRenamed({"k": "start_key", "n": "src"}), "start_key").join(keys.withColumnsRenamed({"k": "end_key", "n": "dst"}), "end_key")
    ready = merged_bags(ready, "src", "dst", "kind")
    old = edges.select("src", "dst", "kind", F.col("id").alias("old_id"), F.col("properties").alias("old_props"))
    both = ready.join(old, ["src", "dst", "kind"], "left")
    return put_edges(
        both.select(F.coalesce("old_id", F.xxhash64("src", "dst", "kind")).alias("id"), "src", "dst", "kind", merge_objects(F.col("old_props"), F.col("properties")).alias("properties")), seq
    )


def _as_map(properties: Column) -> Column:
    return F.coalesce(F.from_json(properties, "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def merged_bags(rows: DataFrame, *keys: str) -> DataFrame:
    """One bag for each key: all bags of its rows merged in the order of their text, so repeats are harmless.

    Of each member the value in the last bag that has it counts; members are
    settled one by one, so no task holds all bags of a key.
    """
    members = rows.select(*keys, "properties", F.explode_outer(_as_map(F.col("properties"))).alias("name", "value"))
    members = members.groupBy(*keys, "name").agg(F.max_by("value", "properties").alias("value"))
    named = F.filter(F.collect_list(F.struct("name", "value")), lambda m: m["name"].isNotNull())
    ordered = F.array_sort(named, lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    return members.groupBy(*keys).agg(F.to_json(F.map_from_entries(ordered)).alias("properties"))


def merge_objects(old: Column, new: Column) -> Column:
    """One JSON object with the members of both; those of ``new`` win."""
    kept = F.map_filter(_as_map(old), lambda k, _: ~F.map_contains_key(_as_map(new), k))
    return F.to_json(F.map_concat(kept, _as_map(new)))


def newest(log: DataFrame) -> DataFrame:
    """The last change of every id; of equal numbers a tombstone counts as last."""
    latest = Window.partitionBy("entity", "id").orderBy(F.col("seq").desc(), (F.col("op") == "del").desc(), F.col("properties").desc())
    return log.withColumn("_rank", F.row_number().over(latest)).where("_rank = 1").drop("_rank")


def _without_dead_ends(edges: DataFrame, log: DataFrame) -> DataFrame:
    """Edges (with ``seq``, null in a base) that no end's tombstone of the same or a later number took along."""
    gone = log.where("entity = 'node' and op = 'del'").groupBy("id").agg(F.max("seq").alias("_gone")).withColumnRenamed("id", "_dead")
    for end in ("src", "dst"):
        older = (F.col(end) == F.col("_dead")) & (F.col("seq").isNull() | (F.col("seq") <= F.col("_gone")))
        edges = edges.join(gone, older, "left_anti")
    return edges


def merged_view(nodes: DataFrame, edges: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) as of the log: base rows without newer changes, and the changes."""
    last = newest(log)
    changed = {e: last.where(F.col("entity") == e) for e in ("node", "edge")}

    def over(base: DataFrame, entity: str, columns: tuple[str, ...]) -> DataFrame:
        kept = base.select(*columns).join(changed[entity].select("id"), "id", "left_anti").withColumn("seq", F.lit(None).cast("long"))
        return kept.unionByName(changed[entity].where("op = 'put'").select(*columns, "seq"))

    live, walked = over(nodes, "node", _NODE).drop("seq"), _without_dead_ends(over(edges, "edge", _EDGE), log).select(*_EDGE)
    for end in ("src", "dst"):
        walked = walked.join(live.select(F.col("id").alias("_n")), F.col(end) == F.col("_n"), "left_semi")
    return live, walked


def pending_edges(nodes: DataFrame, log: DataFrame) -> DataFrame:
    """Edge changes that wait for an end neither base nor log knows; folding carries them over.

    An end whose last change is a tombstone is gone, so its edges wait for nothing.
    """
    last = newest(log)
    live, _ = merged_view(nodes, nodes.sparkSession.createDataFrame([], "id long, src long, dst long, kind string, properties string"), log)
    edges = _without_dead_ends(last.where("entity = 'edge' and op = 'put'"), log)
    gone = last.where("entity = 'node' and op = 'del'").select(F.col("id").alias("_gone"))
    for end in ("src", "dst"):
        edges = edges.join(gone, F.col(end) == F.col("_gone"), "left_anti")
    both = edges.join(live.select(F.col("id").alias("_a")), F.col("src") == F.col("_a"), "left_semi").join(live.select(F.col("id").alias("_b")), F.col("dst") == F.col("_b"), "left_semi")
    return edges.join(both.select("id"), "id", "left_anti").select(*CHANGE.fieldNames())


def merge_segments(older: DataFrame, newer: DataFrame) -> DataFrame:
    """One log of two: the newest change of every id, and a node's last tombstone for the edges it took along."""
    both = older.unionByName(newer)
    last = newest(both)
    tombs = newest(both.where("entity = 'node' and op = 'del'"))
    return last.unionByName(tombs.join(last.where("op = 'del'").select("entity", "id"), ["entity", "id"], "left_anti").select(*last.columns))


def fold(nodes: DataFrame, edges: DataFrame, log: DataFrame, path: str) -> DataFrame:
    """Write base and log as a new base under ``path``; returns what stays in the log.

    Every fold has a folder of its own and its manifest is written last, so a
    reader sees the fold before until this one is whole.
    """
    spark = nodes.sparkSession
    number = log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    folder = f"{path}/fold-{number:020d}-{uuid.uuid4().hex[:8]}"
    live, walked = merged_view(nodes, edges, log)
    rows = {}
    for name, df in (("nodes", live), ("edges", walked), ("log", pending_edges(nodes, log))):
        df.write.parquet(f"{folder}/{name}")
        rows[name] = spark.read.parquet(f"{folder}/{name}").count()
    write_text(spark, f"{folder}/manifest.json", json.dumps({"sequence": number, "rows": rows}))
    return folded(spark, path)[2]


def folded(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, log) of the newest whole fold under ``path``."""
    system, at = file_of(spark, path)
    names = sorted(s.getPath().getName() for s in system.listStatus(at)) if system.exists(at) else []
    whole = [n for n in names if n.startswith("fold-") and system.exists(file_of(spark, f"{path}/{n}/manifest.json")[1])]
    if not whole:
        raise refuse(f"{path} has no whole fold", "snapshot_incomplete")
    folder = f"{path}/{whole[-1]}"
    rows = json.loads("\n".join(r[0] for r in spark.read.text(f"{folder}/manifest.json").collect()))["rows"]
    tables = tuple(spark.read.parquet(f"{folder}/{name}") for name in ("nodes", "edges", "log"))
    if any(df.count() != rows[name] for name, df in zip(("nodes", "edges", "log"), tables, strict=True)):
        raise refuse("row counts differ from the manifest", "snapshot_damaged")
    return tables


def merged_graph(nodes: DataFrame, edges: DataFrame, log: DataFrame) -> Graph:
    return free_graph(*merged_view(nodes, edges, log))


def follow(changes: DataFrame, path: str, checkpoint: str):
    """A streaming query that appends a stream of changes to the log under ``path``.

    A batch that is run again writes the same folder again, so every change is
    in the log once.
    """

    def append(batch: DataFrame, number: int) -> None:
        batch.select(*CHANGE.fieldNames()).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHANGE).option("recursiveFileLookup", "true").parquet(path)


def differences(a: DataFrame, b: DataFrame) -> int:
    """Rows that two tables don't share; 0 if they are equal as multisets."""
    b = b.select(*a.columns)
    return a.exceptAll(b).count() + b.exceptAll(a).count()
