"""Free-form graphs: a JSON document of nodes and edges, and tables with JSON properties.

A document is ``{"metadata": {"source_kind": ...}, "graph": {"nodes": [...],
"edges": [...]}}``.  A node has ``id``, ``kinds`` and ``properties``; an edge
has ``kind``, ``properties`` and two ends.  An end names its node by ``value``
as id (``match_by`` absent or ``id``), by the property ``name``, or by
``property_matchers``, optionally among nodes of a kind.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import refuse
from ..model import Graph, NodeTable
from .json_props import property_map

#: Kinds that a node of a document may have, besides the source kind.
MOST_KINDS = 2
_END = "struct<match_by:string,value:string,kind:string,property_matchers:array<struct<key:string,operator:string,value:string>>>"
_DOCUMENT = f"struct<metadata:struct<source_kind:string>,graph:struct<nodes:array<struct<id:string,kinds:array<string>,properties:variant>>,edges:array<struct<kind:string,start:{_END},end:{_END},properties:variant>>>>"


class Later(Mapping):
    """A mapping that is made when it is first looked at."""

    def __init__(self, make: Callable[[], Mapping]) -> None:
        self._make, self._made = make, None

    def _all(self) -> Mapping:
        if self._made is None:
            self._made = self._make()
        return self._made

    def __getitem__(self, key):
        return self._all()[key]

    def __iter__(self):
        return iter(self._all())

    def __len__(self) -> int:
        return len(self._all())


def once(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key; where all keys differ, which needs only the keys, the rows as they are."""
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return df if twice.isEmpty() else df.dropDuplicates(keys)


def free_graph(nodes: DataFrame, edges: DataFrame | Callable[[], DataFrame], now: int | None = None) -> Graph:
    """A graph of ``nodes(id, kinds, properties)`` and ``edges(id, src, dst, kind, properties)``, properties as JSON text.

    Repeated node ids and edges are dropped to one, edges without both ends are
    dropped.  Edges, or a function that makes them, are looked at only by
    queries that walk them.
    """
    raw = once(nodes.select("id", "kinds", "properties"), ["id"])
    none = F.create_map().cast("map<string,struct<t:string,txt:string,num:double,bool:boolean,arr:array<string>,raw:string>>")
    typed = raw.select("id", "kinds", F.coalesce(property_map(F.col("properties")), none).alias("props"))
    seen = [r[0] for r in raw.select(F.explode("kinds")).distinct().collect()]

    def edge_tables() -> dict[str, DataFrame]:
        known = once(edges() if callable(edges) else edges, ["src", "dst", "kind"])
        whole = known
        for end in ("src", "dst"):
            whole = whole.join(raw.select(F.col("id").alias("_n")), F.col(end) == F.col("_n"), "left_semi")
        numbers = [dict(df.groupBy("kind").count().collect()) for df in (known, whole)]
        # Where no edge lacks an end, queries don't look for ends again.
        rows = (known if numbers[0] == numbers[1] else whole).select("id", "src", "dst", "kind", property_map(F.col("properties")).alias("props"))
        return {k: rows.where(F.col("kind") == k).drop("kind") for k in sorted(numbers[1])}

    return Graph(nodes.sparkSession, [NodeTable(typed, frozenset(), frozenset(seen), raw=raw)], Later(edge_tables), json=True, now=now)


def read_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, unresolved edge rows) of the documents under ``path``.

    A document in which a node has more than ``MOST_KINDS`` kinds or none is
    refused.
    """
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", _DOCUMENT).alias("d"))
    source = F.col("d.metadata.source_kind")
    nodes = parsed.select(source.alias("source"), F.explode("d.graph.nodes").alias("n"))
    nodes = nodes.select(F.col("n.id").alias("key"), F.col("n.kinds").alias("own"), F.when(F.col("source").isNotNull(), F.concat(F.array("source"), "n.kinds")).otherwise(F.col("n.kinds")).alias("kinds"), F.to_json("n.properties").alias("properties"))
    bad = nodes.where((F.size("own") > MOST_KINDS) | (F.size("own") < 1))
    if not bad.isEmpty():
        raise refuse(f"a node needs 1 to {MOST_KINDS} kinds", "invalid_document")
    alike = nodes.groupBy(F.xxhash64("key")).agg(F.count_distinct("key").alias("keys")).where("keys > 1")
    if not alike.isEmpty():
        raise refuse("two node ids with one hash", "invalid_document")
    edges = parsed.select(F.explode("d.graph.edges").alias("e")).select(F.col("e.kind").alias("kind"), F.col("e.start").alias("start"), F.col("e.end").alias("end"), F.to_json("e.properties").alias("properties"))
    return nodes.drop("own").withColumn("id", F.xxhash64("key")), edges


def resolve_edges(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with ids of both ends, edges that name no node).

    Every way of naming is an equi-join on (property, value); of several
    matchers of an end all must fit.  A name that fits several nodes gives an
    edge to each.  Matchers compare by ``equals`` only.
    """
    props = F.from_json("properties", "map<string,string>")
    keys = nodes.select("id", F.lit("id").alias("by"), F.col("key").alias("value"), "kinds")
    named = nodes.select("id", F.explode(props).alias("by", "value"), "kinds").withColumn("by", F.concat(F.lit("."), F.col("by")))
    keys = keys.union(named)
    out = edges.withColumn("row", F.xxhash64(F.to_json(F.struct("kind", "start", "end"))))
    for end in ("start", "end"):
        e = F.col(end)
        other = out.where(F.exists(e["property_matchers"], lambda m: F.coalesce(m["operator"], F.lit("equals")) != "equals"))
        if not other.isEmpty():
            raise refuse("a property matcher other than equals", "invalid_document")
        by_property = F.transform(e["property_matchers"], lambda m: F.struct(F.concat(F.lit("."), m["key"]).alias("by"), m["value"].alias("value")))
        plain = F.array(F.struct(F.when(e["match_by"] == "name", ".name").otherwise("id").alias("by"), e["value"].alias("value")))
        names = F.array_distinct(F.when(e["match_by"] == "property", by_property).otherwise(plain))
        side = out.select("row", e["kind"].alias("want"), F.size(names).alias("wanted"), F.explode(names).alias("m")).distinct()
        fits = side.select("row", "want", "wanted", "m.by", "m.value").join(keys, ["by", "value"]).where(F.col("want").isNull() | F.array_contains("kinds", F.col("want")))
        found = fits.groupBy("row", "id").agg(F.count_distinct("by", "value").alias("fit"), F.max("wanted").alias("wanted")).where("fit = wanted")
        out = out.join(found.select("row", F.col("id").alias(f"{end}_id")).distinct(), "row", "left")
    ready = out.where("start_id is not null and end_id is not null")
    ready = ready.select(F.xxhash64("start_id", "end_id", "kind").alias("id"), F.col("start_id").alias("src"), F.col("end_id").alias("dst"), "kind", "properties")
    return ready, out.where("start_id is null or end_id is null").select("kind", "start", "end")


def document_graph(spark: SparkSession, path: str, now: int | None = None) -> Graph:
    nodes, edges = read_document(spark, path)
    ready, _ = resolve_edges(nodes, edges)
    return free_graph(nodes.select("id", "kinds", "properties"), ready, now)
