"""Saved graphs: Parquet tables and a manifest that is written last.

A folder without a manifest, or with one of another lineage or with other row
counts, is refused.  Every save goes to a folder of its own.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..errors import refuse
from ..model import Graph, NodeTable

FORMAT = 1


def file_of(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A new small file in any store that Spark writes to."""
    system, at = file_of(spark, path)
    out = system.create(at, False)
    out.write(bytearray(text.encode()))
    out.close()


def save_graph(graph: Graph, path: str, sequence: int = 0, lineage: str | None = None) -> str:
    """Write all tables, then the manifest; returns the lineage id."""
    spark, lineage = graph.spark, lineage or uuid.uuid4().hex
    system, at = file_of(spark, path)
    if system.exists(at):
        raise refuse(f"{path} exists", "snapshot_exists")
    nodes, edges = [], {}
    for i, table in enumerate(graph.node_tables):
        table.df.write.parquet(f"{path}/nodes-{i}")
        nodes.append({"always": sorted(table.always), "maybe": sorted(table.maybe), "base": table.base, "key": table.key, "rows": spark.read.parquet(f"{path}/nodes-{i}").count()})
    for i, (kind, df) in enumerate(graph.edge_tables.items()):
        df.write.parquet(f"{path}/edges-{i}")
        edges[kind] = {"table": f"edges-{i}", "rows": spark.read.parquet(f"{path}/edges-{i}").count()}
    manifest = {"format": FORMAT, "lineage": lineage, "sequence": sequence, "json": graph.json, "nodes": nodes, "edges": edges}
    write_text(spark, f"{path}/manifest.json", json.dumps(manifest))
    return lineage


def read_manifest(spark: SparkSession, path: str) -> dict:
    system, at = file_of(spark, f"{path}/manifest.json")
    if not system.exists(at):
        raise refuse(f"{path} has no manifest", "snapshot_incomplete")
    return json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/manifest.json").collect()))


def load_graph(spark: SparkSession, path: str, lineage: str | None = None) -> Graph:
    manifest = read_manifest(spark, path)
    if manifest["format"] != FORMAT:
        raise refuse("another format", "snapshot_format")
    if lineage is not None and manifest["lineage"] != lineage:
        raise refuse("another lineage", "snapshot_lineage")
    tables = []
    for i, held in enumerate(manifest["nodes"]):
        df = spark.read.parquet(f"{path}/nodes-{i}")
        tables.append(NodeTable(df, frozenset(held["always"]), frozenset(held["maybe"]), held.get("base"), held.get("key")))
        _whole(df, held["rows"])
    edges = {}
    for kind, held in manifest["edges"].items():
        edges[kind] = spark.read.parquet(f"{path}/{held['table']}")
        _whole(edges[kind], held["rows"])
    return Graph(spark, tables, edges, manifest["json"])


def _whole(df, rows: int) -> None:
    if df.select(F.count(F.lit(1))).first()[0] != rows:
        raise refuse("row counts differ from the manifest", "snapshot_damaged")
