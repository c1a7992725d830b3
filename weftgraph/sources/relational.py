"""A property graph over relational tables: each kind stays its own Parquet scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Graph, NodeTable
from .scratch import saved

#: Node ids are NODE_BASE * kind number + key; edge ids likewise.
NODE_BASE = 10**12
EDGE_BASE = 10**17
NODE_NUMBERS = {"Region": 1, "Nation": 2, "Customer": 3, "Supplier": 4, "Part": 5, "Order": 6, "Event": 7, "Turn": 8}
EDGE_NUMBERS = {"IN_REGION": 1, "IN_NATION": 2, "PLACED": 3, "CONTAINS": 4, "SUPPLIED_BY": 5, "DID": 6, "NEXT": 7, "NEXT_TURN": 8}
#: Customers with a balance above this are also of kind VIP.
VIP_BALANCE = 9000
_PAIR = 10**7
#: Edges that are grouped or ordered rows of a table: written once a session.
DERIVED = frozenset(("CONTAINS", "SUPPLIED_BY", "NEXT", "NEXT_TURN"))


def _id(kind: str, key):
    return (F.lit(NODE_NUMBERS[kind] * NODE_BASE) + key).cast("bigint")


def _edge_id(kind: str, key):
    return (F.lit(EDGE_NUMBERS[kind] * EDGE_BASE) + key).cast("bigint")


def _epoch(column: str):
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})").cast("bigint")


def commerce_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations, customers, orders, parts, suppliers, events and conversation turns as one graph."""

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def nodes(kind: str, df: DataFrame, key, *props, maybe: str | None = None, condition=None) -> NodeTable:
        kinds = F.array(F.lit(kind))
        if maybe:
            kinds = F.when(condition, F.array(F.lit(kind), F.lit(maybe))).otherwise(kinds)
        # Whole-number keys stay beside the ids, so that a filter on an id reaches the scan.
        rows = df.select(_id(kind, key).alias("id"), kinds.alias("kinds"), key.alias("_key"), *props)
        return NodeTable(rows, frozenset([kind]), frozenset([maybe] if maybe else []), NODE_NUMBERS[kind] * NODE_BASE, "_key")

    def p(column: str, name: str):
        return F.col(column).alias(name)

    customer, supplier, part, orders, events = (read(n) for n in ("customer", "supplier", "part", "orders", "events"))
    lineitem, turns, nation = read("lineitem"), read("conversations"), read("nation")
    turn_key = F.col("conv_id") * 1000 + F.col("turn")
    tables = [
        nodes("Region", read("region"), F.col("r_regionkey"), p("r_name", "name")),
        nodes("Nation", nation, F.col("n_nationkey"), p("n_name", "name")),
        nodes("Customer", customer, F.col("c_custkey"), p("c_name", "name"), p("c_acctbal", "acctbal"), p("c_mktsegment", "mktsegment"), maybe="VIP", condition=F.col("c_acctbal") > VIP_BALANCE),
        nodes("Supplier", supplier, F.col("s_suppkey"), p("s_name", "name"), p("s_acctbal", "acctbal")),
        nodes("Part", part, F.col("p_partkey"), p("p_name", "name"), p("p_brand", "brand"), p("p_type", "type"), p("p_size", "size"), p("p_retailprice", "retailprice")),
        nodes("Order", orders, F.col("o_orderkey"), p("o_orderstatus", "status"), p("o_totalprice", "totalprice"), _epoch("o_orderdate").alias("orderdate"), p("o_orderpriority", "priority")),
        nodes("Event", events, F.col("event_id"), p("event_type", "event_type"), p("value", "value"), _epoch("ts").alias("ts")),
        nodes("Turn", turns, turn_key, p("role", "role")),
    ]

    def edges(kind: str, df: DataFrame, key, src, dst, *props) -> DataFrame:
        return df.select(_edge_id(kind, key).alias("id"), src.alias("src"), dst.alias("dst"), *props)

    # One edge for each pair, whatever number of lines.
    lines = lineitem.groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("lines"))
    supplied = lineitem.select("l_partkey", "l_suppkey").distinct()
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    following = events.select("event_id", F.lead("event_id").over(by_user).alias("next")).where("next is not null")
    spoken = turns.select("conv_id", "turn", F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")).alias("next")).where("next is not null")
    in_nation = edges("IN_NATION", customer, F.col("c_custkey"), _id("Customer", F.col("c_custkey")), _id("Nation", F.col("c_nationkey"))).union(
        edges("IN_NATION", supplier, F.lit(EDGE_BASE // 2) + F.col("s_suppkey"), _id("Supplier", F.col("s_suppkey")), _id("Nation", F.col("s_nationkey")))
    )
    return Graph(
        spark,
        tables,
        {
            "IN_REGION": edges("IN_REGION", nation, F.col("n_nationkey"), _id("Nation", F.col("n_nationkey")), _id("Region", F.col("n_regionkey"))),
            "IN_NATION": in_nation,
            "PLACED": edges("PLACED", orders, F.col("o_orderkey"), _id("Customer", F.col("o_custkey")), _id("Order", F.col("o_orderkey"))),
            "CONTAINS": edges("CONTAINS", lines, F.col("l_orderkey") * _PAIR + F.col("l_partkey"), _id("Order", F.col("l_orderkey")), _id("Part", F.col("l_partkey")), F.col("quantity"), F.col("lines")),
            "SUPPLIED_BY": edges("SUPPLIED_BY", supplied, F.col("l_partkey") * _PAIR + F.col("l_suppkey"), _id("Part", F.col("l_partkey")), _id("Supplier", F.col("l_suppkey"))),
            "DID": edges("DID", events, F.col("event_id"), _id("Customer", F.col("user_id")), _id("Event", F.col("event_id"))),
            "NEXT": edges("NEXT", following, F.col("event_id"), _id("Event", F.col("event_id")), _id("Event", F.col("next"))),
            "NEXT_TURN": edges("NEXT_TURN", spoken, turn_key, _id("Turn", turn_key), _id("Turn", F.col("conv_id") * 1000 + F.col("next"))),
        },
        keep=lambda kind, df: saved(df, "commerce", kind) if kind in DERIVED else df,
    )
