"""Whole nodes and edges in place of the ids that paths are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settled


def entities(graph, edge: bool) -> DataFrame:
    """``id`` and ``entity``: each node (id, kinds, props) or edge (id, src, dst, kind, props) as one struct.

    Properties are a struct of all typed columns, or in a free-form graph a map
    from name to JSON text.
    """
    fields = ["id", "src", "dst", "kind"] if edge else ["id", "kinds"]
    if graph.json:
        tables = {k: d for k, d in graph.edge_tables.items()} if edge else dict(enumerate(t.df for t in graph.node_tables))
        rows = None
        for kind, df in tables.items():
            if edge:
                df = df.withColumn("kind", F.lit(kind))
            held = F.transform_values("props", lambda _, v: F.coalesce(v["raw"], v["txt"])) if "props" in df.columns else F.create_map().cast("map<string,string>")
            df = df.select(*fields, held.alias("props"))
            rows = df if rows is None else rows.unionByName(df)
        return rows.select("id", F.struct(*fields, "props").alias("entity"))
    names = graph.prop_names(edge)
    rows = graph.edges((), tuple(names)) if edge else graph.nodes((), tuple(names))
    props = [F.struct(*(F.col(f"p_{i}").alias(n) for i, n in enumerate(names))).alias("props")] if names else []
    return rows.select("id", F.struct(*fields, *props).alias("entity"))


def whole_paths(graph, df: DataFrame, columns: list[str], ordered: bool) -> DataFrame:
    """``df`` with the path columns' id lists replaced by their nodes and edges, in path order.

    Rows are numbered and settled first; each list is taken apart, joined and
    put together again by its row, so no task needs more than a path.
    """
    names = df.columns
    df = settled(df.withColumn("_row", F.monotonically_increasing_id()))
    for column in columns:
        parts = {}
        for part in ("nodes", "edges"):
            places = df.select("_row", F.posexplode(F.col(f"`{column}`.{part}")).alias("_place", "_id"))
            known = entities(graph, part == "edges").withColumnRenamed("id", "_of")
            lists = places.join(known, F.col("_id") == F.col("_of")).groupBy("_row").agg(F.collect_list(F.struct("_place", "entity")).alias("_list"))
            in_order = F.array_sort("_list", lambda a, b: a["_place"] - b["_place"])
            parts[part] = lists.select("_row", F.transform(in_order, lambda x: x["entity"]).alias(f"_{part}"))
        none = F.array().cast(parts["edges"].schema["_edges"].dataType)
        df = df.join(parts["nodes"], "_row", "left").join(parts["edges"], "_row", "left")
        df = df.withColumn(column, F.when(F.col(f"`{column}`").isNotNull(), F.struct(F.col("_nodes").alias("nodes"), F.coalesce("_edges", none).alias("edges")))).drop("_nodes", "_edges")
    return (df.orderBy("_row") if ordered else df).select(*(F.col(f"`{n}`") for n in names))
