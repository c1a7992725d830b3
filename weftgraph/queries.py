"""Named graph queries over the relational test graph, each with its SQL twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .builder import end_ids, end_kinds, node_ids, node_kinds, node_property, rel_kinds, rel_property, start_ids, start_kinds
from .model import Graph
from .sources.documents import free_graph
from .sources import relational
from .sources.scratch import shared_folder
from .sources.snapshot import load_graph, save_graph
from .streaming import changelog as C


_SESSIONS: dict[str, SparkSession] = {}


@lru_cache(maxsize=8)
def _graph(application: str, sf_dir: str) -> Graph:
    return relational.commerce_graph(_SESSIONS[application], sf_dir)


def commerce_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph over a folder of tables; its schemas are looked up once for each application."""
    application = spark.sparkContext.applicationId
    _SESSIONS[application] = spark
    return _graph(application, sf_dir)


@dataclass(frozen=True)
class Named:
    text: str
    sql: str
    shortest: str | None = None


#: Edges of one kind in SQL.
_NEXT = "nx AS (SELECT event_id AS a, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), ne AS (SELECT a, b FROM nx WHERE b IS NOT NULL)"
_TURN = "tx AS (SELECT conv_id * 1000 + turn AS a, conv_id * 1000 + lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), te AS (SELECT a, b FROM tx WHERE b IS NOT NULL)"
_CONTAINS = "co AS (SELECT l_orderkey AS o, l_partkey AS p, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY ALL)"
_SUPPLIED = "su AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem)"


def _walks(edges: str, relation: str, start: str, high: int) -> str:
    """Trails in an acyclic relation as (s, e, d): every walk is one."""
    return f"WITH RECURSIVE {edges}, w AS (SELECT a AS s, b AS e, 1 AS d FROM {relation} WHERE {start} UNION ALL SELECT w.s, x.b, w.d + 1 FROM w JOIN {relation} x ON x.a = w.e WHERE w.d < {high})"


QUERIES: dict[str, Named] = {
    # Scans.
    "scan_all_nodes_count": Named(
        "MATCH (n) RETURN count(n) AS n",
        "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM events) + (SELECT count(*) FROM conversations) AS n",
    ),
    "scan_kind": Named("MATCH (n:Nation) RETURN id(n) AS id, n.name AS name", "SELECT 2000000000000 + n_nationkey AS id, n_name AS name FROM nation"),
    "scan_all_of_kinds": Named("MATCH (n:Customer:VIP) RETURN id(n) AS id, n.acctbal AS bal", "SELECT 3000000000000 + c_custkey AS id, c_acctbal AS bal FROM customer WHERE c_acctbal > 9000"),
    "where_kind": Named("MATCH (n:Customer) WHERE n:VIP RETURN count(n) AS n", "SELECT count(*) AS n FROM customer WHERE c_acctbal > 9000"),
    "where_kind_or": Named(
        "MATCH (n) WHERE n:Region OR n:Nation RETURN count(n) AS n", "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS n"
    ),
    "id_lookup": Named("MATCH (n:Customer) WHERE id(n) = 3000000000007 RETURN n.name AS name, n.mktsegment AS seg", "SELECT c_name AS name, c_mktsegment AS seg FROM customer WHERE c_custkey = 7"),
    "edge_scan_kind": Named("MATCH ()-[r:PLACED]->() RETURN count(r) AS n", "SELECT count(*) AS n FROM orders"),
    "edge_any_kind": Named(
        "MATCH (c:Customer)-[r]->() RETURN type(r) AS kind, count(*) AS n",
        "SELECT 'IN_NATION' AS kind, count(*) AS n FROM customer UNION ALL SELECT 'PLACED', count(*) FROM orders UNION ALL SELECT 'DID', count(*) FROM events",
    ),
    "edge_kind_alternation": Named(
        "MATCH (c:Customer)-[r:PLACED|DID]->(x) RETURN type(r) AS kind, count(r) AS n", "SELECT 'PLACED' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'DID', count(*) FROM events"
    ),
    "edge_kind_where": Named("MATCH (c:Customer)-[r]->(x) WHERE r:DID RETURN count(r) AS n", "SELECT count(*) AS n FROM events"),
    "edge_properties": Named(
        "MATCH (o:Order)-[r:CONTAINS]->(p:Part) WHERE r.lines > 1 RETURN id(o) AS o, id(p) AS p, r.quantity AS q",
        f"WITH {_CONTAINS} SELECT 6000000000000 + o AS o, 5000000000000 + p AS p, q FROM co WHERE n > 1",
    ),
    # Predicates.
    "property_equals": Named("MATCH (c:Customer) WHERE c.mktsegment = 'BUILDING' RETURN c.name AS name", "SELECT c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "property_map": Named("MATCH (c:Customer {mktsegment: 'FURNITURE'}) RETURN count(c) AS n", "SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'FURNITURE'"),
    "not_equals": Named("MATCH (o:Order) WHERE o.status <> 'F' RETURN count(o) AS n", "SELECT count(*) AS n FROM orders WHERE o_orderstatus <> 'F'"),
    "prefix": Named("MATCH (p:Part) WHERE p.brand STARTS WITH 'Brand#1' RETURN p.brand AS brand, count(p) AS n", "SELECT p_brand AS brand, count(*) AS n FROM part WHERE starts_with(p_brand, 'Brand#1') GROUP BY 1"),
    "suffix": Named("MATCH (p:Part) WHERE p.name ENDS WITH '7' RETURN count(p) AS n", "SELECT count(*) AS n FROM part WHERE suffix(p_name, '7')"),
    "contains": Named("MATCH (p:Part) WHERE p.type CONTAINS 'A' RETURN p.type AS type, count(p) AS n", "SELECT p_type AS type, count(*) AS n FROM part WHERE contains(p_type, 'A') GROUP BY 1"),
    "not_contains_null": Named(
        "MATCH (n) WHERE NOT n.name CONTAINS '1' RETURN count(n) AS n",
        "SELECT (SELECT count(*) FROM region WHERE NOT contains(r_name, '1')) + (SELECT count(*) FROM nation WHERE NOT contains(n_name, '1')) + (SELECT count(*) FROM customer WHERE NOT contains(c_name, '1')) + (SELECT count(*) FROM supplier WHERE NOT contains(s_name, '1')) + (SELECT count(*) FROM part WHERE NOT contains(p_name, '1')) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM events) + (SELECT count(*) FROM conversations) AS n",
    ),
    "like_wildcard": Named("MATCH (c:Customer) WHERE coalesce(c.name, '') CONTAINS '0_1' RETURN count(c) AS n", "SELECT count(*) AS n FROM customer WHERE c_name LIKE '%0_1%'"),
    "regex_ci": Named("MATCH (c:Customer) WHERE c.mktsegment =~ '(?i)^b.*g$' RETURN count(c) AS n", "SELECT count(*) AS n FROM customer WHERE regexp_matches(c_mktsegment, '(?is)^b.*g$')"),
    "in_text_list": Named("MATCH (c:Customer) WHERE c.mktsegment IN ['BUILDING', 'MACHINERY'] RETURN count(c) AS n", "SELECT count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    "in_number_list": Named("MATCH (p:Part) WHERE p.size IN [1, 5, 9] RETURN p.size AS size, count(p) AS n", "SELECT p_size AS size, count(*) AS n FROM part WHERE p_size IN (1, 5, 9) GROUP BY 1"),
    "is_null": Named(
        "MATCH (n) WHERE n.name IS NULL RETURN count(n) AS n", "SELECT (SELECT count(*) FROM orders) + (SELECT count(*) FROM events) + (SELECT count(*) FROM conversations) AS n"
    ),
    "is_not_null": Named("MATCH (n) WHERE n.mktsegment IS NOT NULL RETURN count(n) AS n", "SELECT count(*) AS n FROM customer"),
    "range_pred": Named("MATCH (o:Order) WHERE o.totalprice >= 1000 AND o.totalprice < 50000.5 RETURN count(o) AS n", "SELECT count(*) AS n FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 50000.5"),
    "arith_pred": Named("MATCH (p:Part) WHERE p.size * 2 + 1 > 80 RETURN count(p) AS n", "SELECT count(*) AS n FROM part WHERE p_size * 2 + 1 > 80"),
    "epoch_pred": Named("MATCH (o:Order) WHERE o.orderdate < datetime().epochseconds - 86400 * 60 RETURN count(o) AS n", "SELECT count(*) AS n FROM orders WHERE epoch(o_orderdate) < epoch(now()) - 86400 * 60"),
    "coalesce_pred": Named("MATCH (n) WHERE coalesce(n.mktsegment, n.status, 'none') = 'none' RETURN count(n) AS n",
        "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM events) + (SELECT count(*) FROM conversations) AS n"),
    "boolean_algebra": Named("MATCH (c:Customer) WHERE NOT (c.acctbal < 0 OR c.mktsegment = 'BUILDING') AND (c.name ENDS WITH '1' OR c.name ENDS WITH '2') RETURN count(c) AS n",
        "SELECT count(*) AS n FROM customer WHERE NOT (c_acctbal < 0 OR c_mktsegment = 'BUILDING') AND (suffix(c_name, '1') OR suffix(c_name, '2'))"),
    "concat_equality": Named("MATCH (n:Nation), (r:Region) WHERE n.name = r.name + '' RETURN count(n) AS n", "SELECT count(*) AS n FROM nation, region WHERE n_name = r_name || ''"),
    "text_functions": Named(
        "MATCH (n:Nation) RETURN id(n) AS id, toLower(n.name) AS lo, toUpper(n.name) AS up, size(split(n.name, 'A')) AS parts",
        "SELECT 2000000000000 + n_nationkey AS id, lower(n_name) AS lo, upper(n_name) AS up, len(string_split(n_name, 'A'))::INT AS parts FROM nation",
    ),
    "labels_of": Named("MATCH (c:Customer) RETURN size(labels(c)) AS k, count(c) AS n", "SELECT (CASE WHEN c_acctbal > 9000 THEN 2 ELSE 1 END)::INT AS k, count(*) AS n FROM customer GROUP BY 1"),
    # Joins.
    "hop1": Named("MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.status = 'O' RETURN c.mktsegment AS seg, count(o) AS n", "SELECT c_mktsegment AS seg, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'O' GROUP BY 1"),
    "hop1_in": Named("MATCH (o:Order)<-[:PLACED]-(c:VIP) RETURN count(o) AS n", "SELECT count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 9000"),
    "hop_undirected": Named("MATCH (n:Nation)--(x) RETURN n.name AS name, count(x) AS n",
        "SELECT n_name AS name, 1 + (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n FROM nation"),
    "hop3_chain": Named(
        "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order) RETURN r.name AS region, count(o) AS n",
        "SELECT r_name AS region, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    ),
    "hop5_chain": Named(
        "MATCH (r:Region)<-[:IN_REGION]-(:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order)-[:CONTAINS]->(p:Part)-[:SUPPLIED_BY]->(s:Supplier) WHERE p.size = 7 RETURN r.name AS region, count(s) AS n",
        f"WITH {_CONTAINS}, {_SUPPLIED} SELECT r_name AS region, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN co ON co.o = o_orderkey JOIN part ON p_partkey = co.p JOIN su ON su.p = co.p WHERE p_size = 7 GROUP BY 1",
    ),
    "closing_cycle": Named(
        "MATCH (c:Customer)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(s:Supplier), (c)-[:PLACED]->(:Order)-[:CONTAINS]->(:Part)-[:SUPPLIED_BY]->(s) RETURN n.name AS nation, count(*) AS n",
        f"WITH {_CONTAINS}, {_SUPPLIED} SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN co ON co.o = o_orderkey JOIN su ON su.p = co.p AND su.s = s_suppkey GROUP BY 1",
    ),
    "two_patterns_share": Named(
        "MATCH (c:Customer)-[:PLACED]->(o:Order) MATCH (c)-[:DID]->(e:Event) WHERE e.event_type = 'click' RETURN count(*) AS n",
        "SELECT count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN events ON user_id = c_custkey WHERE event_type = 'click'",
    ),
    "cartesian_small": Named("MATCH (a:Region), (b:Region) WHERE a <> b RETURN count(*) AS n", "SELECT count(*) AS n FROM region a, region b WHERE a.r_regionkey <> b.r_regionkey"),
    "equi_components": Named("MATCH (a:Customer), (b:Supplier) WHERE a.acctbal = b.acctbal RETURN count(*) AS n", "SELECT count(*) AS n FROM customer JOIN supplier ON c_acctbal = s_acctbal"),
    "theta_components": Named("MATCH (a:Supplier), (b:Region) WHERE a.acctbal < id(b) - 1000000000000 RETURN count(*) AS n", "SELECT count(*) AS n FROM supplier, region WHERE s_acctbal < r_regionkey"),
    "edge_uniqueness": Named(
        "MATCH (a:Customer)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(b:Customer) WHERE n.name = 'FRANCE' OR id(n) = 2000000000003 RETURN count(*) AS n",
        "SELECT count(*) AS n FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey <> b.c_custkey JOIN nation ON n_nationkey = a.c_nationkey WHERE n_name = 'FRANCE' OR n_nationkey = 3",
    ),
    "pattern_exists": Named("MATCH (c:Customer) WHERE (c)-[:DID]->(:Event) RETURN count(c) AS n", "SELECT count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)"),
    "pattern_not_exists": Named("MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->(:Order) RETURN count(c) AS n", "SELECT count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "pattern_exists_or": Named("MATCH (c:Customer) WHERE (c)-[:DID]->(:Event) OR c.acctbal > 9000 RETURN count(c) AS n",
        "SELECT count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey) OR c_acctbal > 9000"),
    "optional_match": Named("MATCH (c:Customer) OPTIONAL MATCH (c)-[:DID]->(e:Event) RETURN c.mktsegment AS seg, count(c) AS n, count(e) AS m",
        "SELECT c_mktsegment AS seg, count(*) AS n, count(event_id) AS m FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1"),
    "optional_where": Named("MATCH (n:Nation) OPTIONAL MATCH (n)<-[:IN_NATION]-(s:Supplier) WHERE s.acctbal > 5000 RETURN n.name AS name, count(s) AS n",
        "SELECT n_name AS name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY 1"),
    # Aggregation.
    "count_star": Named("MATCH (e:Event) RETURN e.event_type AS t, count(*) AS n", "SELECT event_type AS t, count(*) AS n FROM events GROUP BY 1"),
    "count_distinct": Named("MATCH (c:Customer)-[:PLACED]->(o:Order)-[:CONTAINS]->(p:Part) RETURN c.mktsegment AS seg, count(DISTINCT p) AS n",
        "SELECT c_mktsegment AS seg, count(DISTINCT l_partkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"),
    "group_by_property": Named("MATCH (p:Part) RETURN p.brand AS brand, p.size AS size, count(p) AS n", "SELECT p_brand AS brand, p_size AS size, count(*) AS n FROM part GROUP BY 1, 2"),
    "with_count": Named("MATCH (n:Nation)<-[:IN_NATION]-(c:Customer) WITH n, count(c) AS k MATCH (n)-[:IN_REGION]->(r:Region) WHERE k > 2 RETURN r.name AS region, n.name AS nation, k AS k",
        "SELECT r_name AS region, n_name AS nation, count(*) AS k FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name, n_name HAVING count(*) > 2"),
    "collect_anti_join": Named("MATCH (c:Customer)-[:DID]->(:Event) WITH collect(c) AS seen MATCH (c:Customer) WHERE NOT c IN seen RETURN count(c) AS n",
        "SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)"),
    "collect_semi_join": Named("MATCH (c:Customer)-[:DID]->(:Event) WITH collect(c) AS seen MATCH (c:Customer) WHERE c IN seen RETURN c.mktsegment AS seg, count(c) AS n",
        "SELECT c_mktsegment AS seg, count(*) AS n FROM customer WHERE c_custkey IN (SELECT user_id FROM events) GROUP BY 1"),
    "with_constant": Named("WITH 7 AS wanted MATCH (p:Part) WHERE p.size = wanted RETURN count(p) AS n", "SELECT count(*) AS n FROM part WHERE p_size = 7"),
    "with_distinct": Named("MATCH (c:Customer)-[:DID]->(:Event) WITH DISTINCT c MATCH (c)-[:PLACED]->(o:Order) RETURN count(o) AS n",
        "SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT user_id FROM events)"),
    "count_of_nothing": Named("MATCH (c:Customer) WHERE c.mktsegment = 'NOWHERE' RETURN count(c) AS n", "SELECT 0::BIGINT AS n"),
    "sum_avg_min_max": Named("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.mktsegment AS seg, min(o.totalprice) AS lo, max(o.totalprice) AS hi, count(o) AS n",
        "SELECT c_mktsegment AS seg, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    # Projection, order and slices.
    "distinct_values": Named("MATCH (p:Part) RETURN DISTINCT p.type AS type", "SELECT DISTINCT p_type AS type FROM part"),
    "order_limit": Named("MATCH (o:Order) RETURN id(o) AS id, o.totalprice AS price ORDER BY o.totalprice DESC, id(o) LIMIT 10", "SELECT 6000000000000 + o_orderkey AS id, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "skip_limit": Named("MATCH (p:Part) RETURN id(p) AS id ORDER BY id(p) SKIP 5 LIMIT 10", "SELECT 5000000000000 + p_partkey AS id FROM part ORDER BY p_partkey OFFSET 5 LIMIT 10"),
    "order_by_count": Named("MATCH (n:Nation)<-[:IN_NATION]-(c:Customer) RETURN n.name AS name, count(c) AS n ORDER BY count(c) DESC, name LIMIT 5",
        "SELECT n_name AS name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"),
    "union_all": Named("MATCH (r:Region) RETURN r.name AS name UNION ALL MATCH (n:Nation) RETURN n.name AS name", "SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation"),
    "unwind_list": Named("UNWIND ['BUILDING', 'MACHINERY'] AS seg MATCH (c:Customer) WHERE c.mktsegment = seg RETURN seg AS seg, count(c) AS n",
        "SELECT c_mktsegment AS seg, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1"),
    "equals_null": Named("MATCH (c:Customer) WHERE c.name = null OR c.acctbal > 9500.5 RETURN count(c) AS n", "SELECT count(*) AS n FROM customer WHERE c_acctbal > 9500.5"),
    "list_equality": Named("MATCH (c:Customer) WHERE labels(c) = ['Customer', 'VIP'] RETURN count(c) AS n", "SELECT count(*) AS n FROM customer WHERE c_acctbal > 9000"),
    "literal_in_list": Named("MATCH (c:Customer) WHERE 'VIP' IN labels(c) RETURN count(c) AS n", "SELECT count(*) AS n FROM customer WHERE c_acctbal > 9000"),
    "size_of_list": Named("MATCH (c:Customer) WHERE size(labels(c)) = 2 RETURN count(c) AS n", "SELECT count(*) AS n FROM customer WHERE c_acctbal > 9000"),
    "order_of_texts": Named("MATCH (p:Part) WHERE p.brand < p.name RETURN count(p) AS n", "SELECT count(*) AS n FROM part WHERE p_brand < p_name"),
    "quotient_and_rest": Named("MATCH (p:Part) WHERE p.retailprice / 2.0 > 600 AND p.size % 5 = 0 AND p.size * -1 < -10 RETURN count(p) AS n",
        "SELECT count(*) AS n FROM part WHERE p_retailprice / 2.0 > 600 AND p_size % 5 = 0 AND -p_size < -10"),
    "branching_tree": Named("MATCH (c:VIP)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r), (s:Supplier)-[:IN_NATION]->(n), (c)-[:PLACED]->(o) WHERE o.status = 'F' RETURN r.name AS region, count(*) AS n",
        "SELECT r_name AS region, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey JOIN supplier ON s_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 9000 AND o_orderstatus = 'F' GROUP BY 1"),
    "nulls_last": Named("MATCH (n:Nation) OPTIONAL MATCH (n)<-[:IN_NATION]-(s:Supplier) WHERE s.acctbal > 2000.5 RETURN n.name AS name, s.acctbal AS b ORDER BY b DESC, name SKIP 2 LIMIT 20",
        "SELECT n_name AS name, s_acctbal AS b FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 2000.5 ORDER BY b DESC NULLS FIRST, name LIMIT 20 OFFSET 2"),
    "absent_kind": Named("MATCH (n:Nowhere) RETURN count(n) AS n", "SELECT 0::BIGINT AS n"),
    "limit_of_all": Named("MATCH (n) WITH n LIMIT 7 RETURN count(n) AS n", "SELECT 7::BIGINT AS n"),
    "exists_anchor": Named("MATCH (p:Part) WHERE (p)<-[:CONTAINS]-(:Order) AND p.size = 7 RETURN count(p) AS n", "SELECT count(*) AS n FROM part WHERE p_size = 7 AND p_partkey IN (SELECT l_partkey FROM lineitem)"),
    "varlen_to_known_end": Named("MATCH p = (c:Customer)-[:IN_NATION|IN_REGION*1..5]->(r:Region) WHERE id(r) = 1000000000002 RETURN length(p) AS d, count(*) AS n",
        "SELECT 2::BIGINT AS d, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2 HAVING count(*) > 0"),
    "sum_distinct": Named("MATCH (p:Part) WHERE p.size < 30 RETURN p.brand AS brand, sum(DISTINCT p.size) AS s, avg(DISTINCT p.size) AS a, count(DISTINCT p.size) AS n",
        "SELECT p_brand AS brand, sum(DISTINCT p_size)::DOUBLE AS s, avg(DISTINCT p_size) AS a, count(DISTINCT p_size) AS n FROM part WHERE p_size < 30 GROUP BY 1"),
    "sum_avg": Named("MATCH (p:Part) RETURN p.brand AS brand, sum(p.size) AS s, avg(p.size) AS a", "SELECT p_brand AS brand, sum(p_size)::DOUBLE AS s, avg(p_size) AS a FROM part GROUP BY 1"),
    "number_in_list": Named("MATCH (s:Supplier) WHERE s.acctbal IN [1, 2.5] OR id(s) IN [4000000000001, 4000000000002] RETURN id(s) AS id", "SELECT 4000000000000 + s_suppkey AS id FROM supplier WHERE s_acctbal IN (1, 2.5) OR s_suppkey IN (1, 2)"),
    "case_expression": Named("MATCH (c:Customer) RETURN CASE WHEN c.acctbal > 5000 THEN 'high' ELSE 'low' END AS level, count(c) AS n",
        "SELECT CASE WHEN c_acctbal > 5000 THEN 'high' ELSE 'low' END AS level, count(*) AS n FROM customer GROUP BY 1"),
    # Variable length and shortest paths.
    "varlen_1_3": Named("MATCH (a:Event)-[:NEXT*1..3]->(b:Event) WHERE a.event_type = 'purchase' RETURN count(*) AS n",
        _walks(_NEXT, "ne", "a IN (SELECT event_id FROM events WHERE event_type = 'purchase')", 3) + " SELECT count(*) AS n FROM w"),
    "varlen_zero": Named("MATCH (a:Turn)-[:NEXT_TURN*0..2]->(b:Turn) WHERE a.role = 'system' RETURN count(*) AS n",
        _walks(_TURN, "te", "a IN (SELECT conv_id * 1000 + turn FROM conversations WHERE role = 'system')", 2) + " SELECT (SELECT count(*) FROM w) + (SELECT count(*) FROM conversations WHERE role = 'system') AS n"),
    "varlen_path_length": Named("MATCH p = (a:Turn)-[:NEXT_TURN*1..]->(b:Turn) WHERE a.role = 'user' RETURN length(p) AS d, count(p) AS n",
        _walks(_TURN, "te", "a IN (SELECT conv_id * 1000 + turn FROM conversations WHERE role = 'user')", 15) + " SELECT d::BIGINT AS d, count(*) AS n FROM w GROUP BY 1"),
    "varlen_mixed_chain": Named("MATCH (c:VIP)-[:DID]->(a:Event)-[:NEXT*1..2]->(b:Event) RETURN id(c) AS c, count(b) AS n",
        _walks(_NEXT, "ne", "TRUE", 2) + " SELECT 3000000000000 + c_custkey AS c, count(*) AS n FROM customer JOIN events ON user_id = c_custkey JOIN w ON w.s = event_id WHERE c_acctbal > 9000 GROUP BY 1"),
    "two_varlen_segments": Named("MATCH (a:Turn)-[:NEXT_TURN*1..2]->(b:Turn)-[:NEXT_TURN*1..2]->(c:Turn) RETURN count(*) AS n",
        _walks(_TURN, "te", "TRUE", 2) + " SELECT count(*) AS n FROM w x JOIN w y ON x.e = y.s"),
    "varlen_reverse": Named("MATCH (a:Turn)<-[:NEXT_TURN*2..4]-(b:Turn) WHERE a.role = 'assistant' RETURN count(*) AS n",
        _walks(_TURN, "te", "TRUE", 4) + " SELECT count(*) AS n FROM w JOIN conversations ON e = conv_id * 1000 + turn WHERE role = 'assistant' AND d >= 2"),
    "shortest_one_length": Named("MATCH p = shortestPath((a:Turn)-[:NEXT_TURN*1..]->(b:Turn)) WHERE a.role = 'system' AND b.role = 'assistant' RETURN id(a) AS a, id(b) AS b, length(p) AS d",
        _walks(_TURN, "te", "a IN (SELECT conv_id * 1000 + turn FROM conversations WHERE role = 'system')", 15) + " SELECT 8000000000000 + s AS a, 8000000000000 + e AS b, min(d)::BIGINT AS d FROM w JOIN conversations ON e = conv_id * 1000 + turn WHERE role = 'assistant' GROUP BY 1, 2"),
    "shortest_all_count": Named(
        "MATCH p = allShortestPaths((c:Customer)-[:PLACED|CONTAINS|SUPPLIED_BY*1..]->(s:Supplier)) WHERE id(c) = 3000000000007 AND s.acctbal > 0 RETURN id(s) AS s, length(p) AS d, count(p) AS n",
        f"WITH {_CONTAINS}, {_SUPPLIED} SELECT 4000000000000 + s_suppkey AS s, 3::BIGINT AS d, count(*) AS n FROM orders JOIN co ON co.o = o_orderkey JOIN su ON su.p = co.p JOIN supplier ON s_suppkey = su.s WHERE o_custkey = 7 AND s_acctbal > 0 GROUP BY 1",
    ),
    "shortest_overall": Named("MATCH p = allShortestPaths((c:VIP)-[:IN_NATION|IN_REGION*1..]->(r:Region)) RETURN length(p) AS d, count(p) AS n",
        "SELECT 2::BIGINT AS d, count(*) AS n FROM customer WHERE c_acctbal > 9000"),
    "shortest_undirected": Named("MATCH p = shortestPath((a:Region)-[:IN_REGION*1..4]-(b:Nation)) RETURN id(a) AS a, id(b) AS b, length(p) AS d",
        "SELECT 1000000000000 + n_regionkey AS a, 2000000000000 + n_nationkey AS b, 1::BIGINT AS d FROM nation"),
}


#: Queries over events as nodes with their JSON properties.
JSON_QUERIES: dict[str, Named] = {
    "json_number_equals": Named("MATCH (e:click) WHERE e.k = 7 RETURN id(e) AS id", "SELECT event_id AS id FROM events WHERE event_type = 'click' AND (props->>'k')::BIGINT = 7"),
    "json_number_order": Named("MATCH (e) WHERE e.k < 20 AND e.k >= 5 RETURN count(e) AS n", "SELECT count(*) AS n FROM events WHERE (props->>'k')::BIGINT < 20 AND (props->>'k')::BIGINT >= 5"),
    "json_text_list": Named("MATCH (e) WHERE e.k IN ['3', '14'] RETURN count(e) AS n", "SELECT count(*) AS n FROM events WHERE props->>'k' IN ('3', '14')"),
    "json_absent": Named("MATCH (e) WHERE e.missing IS NULL AND NOT e.missing CONTAINS 'x' RETURN count(e) AS n", "SELECT count(*) AS n FROM events"),
    "json_type_mismatch": Named("MATCH (e) WHERE e.k <> 'text' RETURN count(e) AS n", "SELECT count(*) AS n FROM events WHERE props->>'k' IS NOT NULL"),
    "json_group": Named("MATCH (e:purchase) RETURN e.k AS k, count(e) AS n", "SELECT props->>'k' AS k, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1"),
    "json_hop": Named("MATCH (a)-[:NEXT]->(b) WHERE a.k = b.k RETURN count(*) AS n",
        f"WITH {_NEXT} SELECT count(*) AS n FROM ne JOIN events x ON x.event_id = ne.a JOIN events y ON y.event_id = ne.b WHERE x.props->>'k' = y.props->>'k'"),
    "json_arithmetic": Named("MATCH (e) WHERE e.k * 2 + 1 = 15 RETURN count(e) AS n", "SELECT count(*) AS n FROM events WHERE (props->>'k')::DOUBLE * 2 + 1 = 15"),
}


def event_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Events as nodes of a free-form graph, each linked to its user's next."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    nodes = events.select(F.col("event_id").alias("id"), F.array("event_type").alias("kinds"), F.col("props").alias("properties"))

    def edges() -> DataFrame:
        following = commerce_graph(spark, sf_dir).edges(("NEXT",))
        base = 7 * 10**12
        return following.select("id", (F.col("src") - base).alias("src"), (F.col("dst") - base).alias("dst"), "kind", F.lit(None).cast("string").alias("properties"))

    return free_graph(nodes, edges)


def _one(spark: SparkSession, name: str, value: int) -> DataFrame:
    return spark.range(1).select(F.lit(value).cast("bigint").alias(name))


def _base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers and nations as base tables of a change log."""
    graph = commerce_graph(spark, sf_dir)
    nodes = graph.nodes(("Customer",)).union(graph.nodes(("Nation",))).select("id", "kinds", F.lit("{}").alias("properties"))
    edges = graph.edges(("IN_NATION",)).select("id", "src", "dst", "kind", F.lit(None).cast("string").alias("properties"))
    return nodes, edges.where(F.col("src") < 4 * 10**12)


def _log(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Customers of keys ending in 3 go; every edge to nation 1 goes and comes back as another kind."""
    moved = edges.where("dst = 2000000000001").withColumn("kind", F.lit("LEFT"))
    log = C.delete_nodes(nodes.where("id >= 3000000000000 and id % 10 = 3"), 1)
    return log.union(C.delete_edges(edges.where("dst = 2000000000001").select("id"), 2)).union(C.put_edges(moved, 3))


def _delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _base(spark, sf_dir)
    _, walked = C.merged_view(nodes, edges, _log(nodes, edges))
    return walked.groupBy("kind").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def _upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    bag = lambda *c: F.to_json(F.struct(F.col("c_name").alias("objectid"), *c))
    nodes = customer.select(F.col("c_custkey").alias("id"), F.array(F.lit("Customer")).alias("kinds"), bag().alias("properties"))
    rows = customer.where("c_custkey % 7 = 0").select(F.array(F.lit("Seen")).alias("kinds"), bag(F.lit(1).alias("seen")).alias("properties"))
    live, _ = C.merged_view(nodes, nodes.select("id", F.col("id").alias("src"), F.col("id").alias("dst"), F.lit("X").alias("kind"), "properties").where("false"), C.upsert_nodes(nodes, rows, 1))
    return live.groupBy(F.size("kinds").alias("kinds"), F.get_json_object("properties", "$.seen").alias("seen")).agg(F.count("*").alias("n"))


def _cascaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation 1 goes, comes back, and gets back the customers of keys that end in 0 or 5."""
    nodes, edges = _base(spark, sf_dir)
    nation = nodes.where("id = 2000000000001")
    again = edges.where("dst = 2000000000001 and src % 5 = 0")
    log = C.delete_nodes(nation, 1).union(C.put_nodes(nation, 2)).union(C.put_edges(again, 3))
    _, walked = C.merged_view(nodes, edges, log)
    return walked.groupBy((F.col("dst") - 2 * 10**12).alias("nation")).agg(F.count("*").alias("n"), F.max("id").alias("last"))


def _upserted_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two bags for one key and batch: members of both are there."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    bag = lambda *c: F.to_json(F.struct(F.col("c_name").alias("objectid"), *c))
    nodes = customer.select(F.col("c_custkey").alias("id"), F.array(F.lit("Customer")).alias("kinds"), bag(F.col("c_mktsegment").alias("seg")).alias("properties"))
    some = customer.where("c_custkey % 3 = 0")
    rows = some.select(F.array(F.lit("Customer")).alias("kinds"), bag(F.col("c_nationkey").alias("nation")).alias("properties"))
    rows = rows.union(some.select(F.array(F.lit("Customer")).alias("kinds"), bag((F.col("c_custkey") % 4).alias("quarter")).alias("properties")))
    none = nodes.select("id", F.col("id").alias("src"), F.col("id").alias("dst"), F.lit("X").alias("kind"), "properties").where("false")
    live, _ = C.merged_view(nodes, none, C.upsert_nodes(nodes, rows, 1))
    member = lambda n: F.get_json_object("properties", f"$.{n}").alias(n)
    return live.groupBy(member("seg"), member("nation"), member("quarter")).agg(F.count("*").alias("n"))


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log folded into a new base; edges to a node that is not there yet stay in the log."""
    nodes, edges = _base(spark, sf_dir)
    early = edges.where("src % 100 = 1").withColumn("dst", F.lit(2 * 10**12 + 999)).withColumn("id", -F.col("id"))
    path = f"{shared_folder(spark)}/fold-{uuid.uuid4().hex[:12]}"
    C.fold(nodes, edges, _log(nodes, edges).union(C.put_edges(early, 4)), path)
    live, walked, left = C.folded(spark, path)
    count = lambda df, name: df.agg(F.count("*").alias("n"), F.min("id").alias("least")).select(F.lit(name).alias("part"), "n", "least")
    return count(live, "nodes").union(count(walked, "edges")).union(count(left, "log"))


def _whole_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "MATCH p = (c:VIP)-[:IN_NATION]->(n)-[:IN_REGION]->(r) RETURN p"
    paths = commerce_graph(spark, sf_dir).query(text)
    node, edge = (lambda i: F.col("p.nodes")[i]), (lambda i: F.col("p.edges")[i])
    return paths.select(node(0)["props"]["name"].alias("customer"), node(1)["props"]["name"].alias("nation"), F.element_at(node(2)["kinds"], 1).alias("kind"), edge(1)["id"].alias("edge"))


def _saved_and_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and regions saved as a graph of their own, loaded by lineage and asked."""
    whole = commerce_graph(spark, sf_dir)
    part = Graph(spark, [t for t in whole.node_tables if t.always & {"Nation", "Region"}], {"IN_REGION": whole.edge_tables["IN_REGION"]})
    path = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex[:12]}"
    lineage = save_graph(part, path, 5)
    return load_graph(spark, path, lineage).query("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, count(n) AS n")


def _emptied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after deleting a kind of nodes, a kind of edges, or all nodes."""
    nodes, edges = _base(spark, sf_dir)
    graph = commerce_graph(spark, sf_dir)
    kinds = nodes.select("id", "kinds")
    logs = {"nodes of a kind": C.delete_nodes_by_kinds(kinds, 1, ["Customer"], ["VIP"]), "edges of a kind": C.delete_edges_by_kinds(edges, 1, ["IN_NATION"]), "all": C.wipe(graph.nodes(("Customer",)).union(graph.nodes(("Nation",))), 1)}
    out = None
    for name, log in logs.items():
        live, walked = C.merged_view(nodes, edges, log)
        row = live.agg(F.count("*").alias("nodes")).crossJoin(walked.agg(F.count("*").alias("edges"))).select(F.lit(name).alias("deleted"), "nodes", "edges")
        out = row if out is None else out.union(row)
    return out


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log in two segments, merged, and one replayed from a sequence on, give what the whole log gives."""
    nodes, edges = _base(spark, sf_dir)
    log = _log(nodes, edges)
    _, whole = C.merged_view(nodes, edges, log)
    _, merged = C.merged_view(nodes, edges, C.merge_segments(log.where("seq <= 2"), C.after(log, 2)))
    live, early = C.merged_view(nodes, edges, log.where("seq <= 1"))
    _, replayed = C.merged_view(live, early, C.after(log, 1))
    return spark.createDataFrame([(C.differences(whole, merged), C.differences(whole, replayed), whole.count())], "merged long, replayed long, edges long")


#: Builder and change-log queries: (function, SQL).
BUILT: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "builder_node_count": (
        lambda spark, d: _one(spark, "n", commerce_graph(spark, d).builder().nodes().filter(node_kinds("Region", "Nation")).count()),
        "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS n",
    ),
    "builder_node_ids": (
        lambda spark, d: commerce_graph(spark, d).builder().nodes().filter(node_kinds("Customer"), node_kinds("VIP")).fetch_ids(),
        "SELECT 3000000000000 + c_custkey AS id FROM customer WHERE c_acctbal > 9000",
    ),
    "builder_node_property": (
        lambda spark, d: commerce_graph(spark, d).builder().nodes().filter(node_kinds("Part"), node_property("size", "<", 5)).fetch_ids(),
        "SELECT 5000000000000 + p_partkey AS id FROM part WHERE p_size < 5",
    ),
    "builder_node_by_ids": (
        lambda spark, d: commerce_graph(spark, d).builder().nodes().filter(node_ids(2000000000001, 2000000000002)).fetch_ids(),
        "SELECT 2000000000000 + n_nationkey AS id FROM nation WHERE n_nationkey IN (1, 2)",
    ),
    "builder_rel_count": (
        lambda spark, d: _one(spark, "n", commerce_graph(spark, d).builder().relationships().filter(rel_kinds("IN_NATION"), start_kinds("Supplier")).count()),
        "SELECT count(*) AS n FROM supplier",
    ),
    "builder_rel_triples": (
        lambda spark, d: commerce_graph(spark, d).builder().relationships().filter(rel_kinds("PLACED"), start_kinds("VIP")).fetch_triples(),
        "SELECT 300000000000000000 + o_orderkey AS id, 3000000000000 + o_custkey AS src, 6000000000000 + o_orderkey AS dst FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 9000",
    ),
    "builder_rel_kinds": (
        lambda spark, d: commerce_graph(spark, d).builder().relationships().filter(start_ids(3000000000007)).fetch_kinds().groupBy("kind").agg(F.count("*").alias("n")),
        "SELECT * FROM (SELECT 'IN_NATION' AS kind, count(*) AS n FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'PLACED', count(*) FROM orders WHERE o_custkey = 7 UNION ALL SELECT 'DID', count(*) FROM events WHERE user_id = 7) WHERE n > 0",
    ),
    "builder_step_out": (
        lambda spark, d: commerce_graph(spark, d).builder().relationships().filter(rel_kinds("IN_REGION"), end_kinds("Region")).fetch_step().select("node_id", F.element_at("node_kinds", 1).alias("kind"), "rel_id"),
        "SELECT 1000000000000 + n_regionkey AS node_id, 'Region' AS kind, 100000000000000000 + n_nationkey AS rel_id FROM nation",
    ),
    "builder_node_page": (
        lambda spark, d: commerce_graph(spark, d).builder().nodes().filter(node_kinds("Part")).order_by("size", False).order_by("id").offset(3).limit(5).fetch_ids(),
        "SELECT 5000000000000 + p_partkey AS id FROM part ORDER BY p_size DESC, p_partkey LIMIT 5 OFFSET 3",
    ),
    "builder_node_fetch": (
        lambda spark, d: commerce_graph(spark, d).builder().nodes().filter(node_kinds("Nation")).fetch().select("entity.id", F.element_at("entity.kinds", 1).alias("kind"), "entity.props.name"),
        "SELECT 2000000000000 + n_nationkey AS id, 'Nation' AS kind, n_name AS name FROM nation",
    ),
    "builder_rel_property": (
        lambda spark, d: commerce_graph(spark, d).builder().relationships().filter(rel_kinds("CONTAINS"), rel_property("quantity", ">", 49.0), rel_property("lines", "=", 1)).fetch_ends(),
        "SELECT 6000000000000 + l_orderkey AS src, 5000000000000 + l_partkey AS dst FROM lineitem GROUP BY l_orderkey, l_partkey HAVING sum(l_quantity) > 49 AND count(*) = 1",
    ),
    "builder_rel_first": (
        lambda spark, d: spark.createDataFrame([commerce_graph(spark, d).builder().relationships().filter(rel_kinds("IN_REGION")).order_by("id", False).first().entity[:4]], "id long, src long, dst long, kind string"),
        "SELECT 100000000000000000 + n_nationkey AS id, 2000000000000 + n_nationkey AS src, 1000000000000 + n_regionkey AS dst, 'IN_REGION' AS kind FROM nation ORDER BY n_nationkey DESC LIMIT 1",
    ),
    "builder_rel_ids": (
        lambda spark, d: commerce_graph(spark, d).builder().relationships().filter(rel_kinds("IN_REGION", "IN_NATION"), end_ids(1000000000001)).fetch_ids(),
        "SELECT 100000000000000000 + n_nationkey AS id FROM nation WHERE n_regionkey = 1",
    ),
    "builder_node_kinds": (
        lambda spark, d: commerce_graph(spark, d).builder().nodes().filter(node_ids(*range(3000000000000, 3000000000050))).fetch_kinds().select("id", F.array_join("kinds", "+").alias("kinds")),
        "SELECT 3000000000000 + c_custkey AS id, CASE WHEN c_acctbal > 9000 THEN 'Customer+VIP' ELSE 'Customer' END AS kinds FROM customer WHERE c_custkey < 50",
    ),
    "builder_directed_graph": (
        lambda spark, d: commerce_graph(spark, d).builder().relationships().filter(rel_kinds("SUPPLIED_BY")).fetch_directed_graph(),
        "SELECT DISTINCT 5000000000000 + l_partkey AS src, 4000000000000 + l_suppkey AS dst FROM lineitem",
    ),
    "builder_shortest_paths": (
        lambda spark, d: commerce_graph(spark, d).builder().relationships().filter(start_ids(3000000000003), end_ids(1000000000000), rel_kinds("IN_NATION", "IN_REGION")).fetch_all_shortest_paths().select(F.element_at("nodes", 2).alias("via"), F.size("edges").alias("d")),
        "SELECT 2000000000000 + c_nationkey AS via, 2::INT AS d FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 3 AND n_regionkey = 0",
    ),
    "delta_merged_view": (
        _delta,
        "SELECT kind, count(*) AS n, min(id) AS first FROM (SELECT CASE WHEN c_nationkey = 1 THEN 'LEFT' ELSE 'IN_NATION' END AS kind, 200000000000000000 + c_custkey AS id FROM customer WHERE c_custkey % 10 <> 3) GROUP BY 1",
    ),
    "paths_whole": (
        _whole_paths,
        "SELECT c_name AS customer, n_name AS nation, 'Region' AS kind, 100000000000000000 + n_nationkey AS edge FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 9000",
    ),
    "snapshot_round_trip": (_saved_and_loaded, "SELECT r_name AS region, count(*) AS n FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1"),
    "delta_deletes_by_kind": (
        _emptied,
        "WITH c AS (SELECT count(*) AS n, count(*) FILTER (c_acctbal > 9000) AS v FROM customer), x AS (SELECT count(*) AS n FROM nation) "
        "SELECT 'nodes of a kind' AS deleted, v + x.n AS nodes, v AS edges FROM c, x UNION ALL SELECT 'edges of a kind', c.n + x.n, 0 FROM c, x UNION ALL SELECT 'all', 0, 0",
    ),
    "delta_segments_and_replay": (_replayed, "SELECT 0::BIGINT AS merged, 0::BIGINT AS replayed, count(*) AS edges FROM customer WHERE c_custkey % 10 <> 3"),
    "delta_delete_cascade": (
        _cascaded,
        "SELECT c_nationkey::BIGINT AS nation, count(*) AS n, max(200000000000000000 + c_custkey) AS last FROM customer WHERE c_nationkey <> 1 OR c_custkey % 5 = 0 GROUP BY 1",
    ),
    "delta_upsert_merge": (
        _upserted_twice,
        "SELECT c_mktsegment AS seg, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey::VARCHAR END AS nation, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 4)::VARCHAR END AS quarter, count(*) AS n FROM customer GROUP BY 1, 2, 3",
    ),
    "delta_fold": (
        _folded,
        "SELECT 'nodes' AS part, (SELECT count(*) FROM customer WHERE c_custkey % 10 <> 3) + (SELECT count(*) FROM nation) AS n, 2000000000000 AS least "
        "UNION ALL SELECT 'edges', count(*), min(200000000000000000 + c_custkey) FROM customer WHERE c_custkey % 10 <> 3 "
        "UNION ALL SELECT 'log', count(*), min(-200000000000000000 - c_custkey) FROM customer WHERE c_custkey % 100 = 1",
    ),
    "delta_upsert": (
        _upserted,
        "SELECT (CASE WHEN c_custkey % 7 = 0 THEN 2 ELSE 1 END)::INT AS kinds, CASE WHEN c_custkey % 7 = 0 THEN '1' END AS seen, count(*) AS n FROM customer GROUP BY 1, 2",
    ),
}


def _asked(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = QUERIES[name]
        return commerce_graph(spark, sf_dir).query(q.text, shortest=q.shortest)

    return run


def _asked_json(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: event_graph(spark, sf_dir).query(JSON_QUERIES[name].text)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) WHERE c.mktsegment = 'FURNITURE' RETURN n.name AS nation, count(c) AS customers"
    return commerce_graph(spark, sf_dir).query(text)


FLAGSHIP_SQL = "SELECT n_name AS nation, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'FURNITURE' GROUP BY 1"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {"flagship": flagship} | {name: _asked(name) for name in QUERIES} | {name: _asked_json(name) for name in JSON_QUERIES}
    return out | {name: run for name, (run, _) in BUILT.items()}


def oracle_sql() -> dict[str, str]:
    out = {"flagship": FLAGSHIP_SQL} | {name: q.sql for name, q in (QUERIES | JSON_QUERIES).items()}
    return out | {name: sql for name, (_, sql) in BUILT.items()}


__all__ = ["QUERIES", "flagship", "oracle_sql", "queries"]
