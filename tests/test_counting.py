"""Counts of matches that are summed name by name, against plain enumeration."""

import itertools
import random
import threading

import pytest
from pyspark.sql import functions as F

from weftgraph.model import Graph, NodeTable


def random_graph(spark, seed):
    rng = random.Random(seed)
    kinds = {i: ["A"] + (["M"] if i % 2 else []) if i < 6 else ["B"] for i in range(10)}
    edges = sorted({(rng.randrange(10), rng.randrange(10), rng.choice("RS")) for _ in range(26)})
    edges = [(100 + i, *e) for i, e in enumerate(edges)]
    schema = "id long, kinds array<string>, v long"
    rows = [(i, k, i % 3) for i, k in kinds.items()]
    tables = [NodeTable(spark.createDataFrame([r for r in rows if r[0] < 6], schema), frozenset("A"), frozenset("M")), NodeTable(spark.createDataFrame([r for r in rows if r[0] > 5], schema), frozenset("B"))]
    made = {k: spark.createDataFrame([(i, a, b, a + b) for i, a, b, x in edges if x == k], "id long, src long, dst long, w long") for k in "RS"}
    return Graph(spark, tables, made), kinds, edges


def brute(kinds, edges, patterns, nodes, where=lambda n, e: True):
    """Bindings of nodes and edges: each pattern a list of (edge name, kinds, from, to), its edges all different."""
    flat = [x for p in patterns for x in p]
    for picked in itertools.product(*([e for e in edges if e[3] in k] for _, k, _, _ in flat)):
        bound, fits = {}, True
        for (_, _, a, b), e in zip(flat, picked, strict=True):
            for name, value in ((a, e[1]), (b, e[2])):
                fits = fits and bound.setdefault(name, value) == value
        at = 0
        for p in patterns:
            own = [e[0] for e in picked[at : at + len(p)]]
            fits, at = fits and len(set(own)) == len(own), at + len(p)
        if fits and all(set(k) <= set(kinds[bound[n]]) for n, k in nodes.items()) and where(bound, dict(zip([x[0] for x in flat], picked, strict=True))):
            yield bound


CASES = [
    ("MATCH (a:A)-[r:R]->(n)<-[s:R]-(b:A) RETURN count(*) AS n", [[("r", "R", "a", "n"), ("s", "R", "b", "n")]], {"a": "A", "b": "A"}, None),
    ("MATCH (a:A)-[r:R]->(n)<-[s:R]-(b:B) RETURN n.v AS v, count(b) AS n", [[("r", "R", "a", "n"), ("s", "R", "b", "n")]], {"a": "A", "b": "B"}, "n"),
    ("MATCH (a)-[r]->(b)-[s]->(c)-[t:R]->(a) RETURN a.v AS v, count(*) AS n", [[("r", "RS", "a", "b"), ("s", "RS", "b", "c"), ("t", "R", "c", "a")]], {}, "a"),
    ("MATCH (a:A)-[r:R]->(b), (a)-[s:R]->(c), (c)-[t:S]->(c) RETURN count(*) AS n", [[("r", "R", "a", "b")], [("s", "R", "a", "c")], [("t", "S", "c", "c")]], {"a": "A"}, None),
    ("MATCH (a:M)-[r:R]->(b)-[s:S]->(c:A) MATCH (c)-[t:R]->(d) WHERE d.v = 1 AND r.w > 4 RETURN b.v AS v, count(t) AS n", [[("r", "R", "a", "b"), ("s", "S", "b", "c")], [("t", "R", "c", "d")]], {"a": "M", "c": "A"}, "b"),
    ("MATCH (a:B)-[r:R]->(b), (c:A)-[s:S]->(d) RETURN b.v AS v, count(*) AS n", [[("r", "R", "a", "b")], [("s", "S", "c", "d")]], {"a": "B", "c": "A"}, "b"),
]


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize(("text", "patterns", "nodes", "by"), CASES)
def test_counts_are_those_of_all_matches(spark, seed, text, patterns, nodes, by):
    graph, kinds, edges = random_graph(spark, seed)
    where = (lambda n, e: n["d"] % 3 == 1 and e["r"][1] + e["r"][2] > 4) if "WHERE" in text else (lambda n, e: True)
    want = {}
    for bound in brute(kinds, edges, patterns, nodes, where):
        want[bound[by] % 3 if by else None] = want.get(bound[by] % 3 if by else None, 0) + 1
    got = {(r.v if by else None): r.n for r in graph.query(text).collect()}
    assert got == (want or ({} if by else {None: 0}))


@pytest.mark.parametrize(("text", "want"), [
    ("MATCH (a:Leaf)-[:IN]->(h)<-[:IN]-(b:Leaf) RETURN count(*) AS n", 10**12 - 10**6),
    ("MATCH (a:Leaf)-[:IN]->(h:Hub)<-[:IN]-(b:Leaf), (a)-[:AT]->(p)<-[:AT]-(b) RETURN count(*) AS n", 0),
    ("MATCH (a:Leaf)-[:IN]->(h:Hub), (b:Leaf)-[:IN]->(h), (c:Leaf)-[:IN]->(h) RETURN h.name AS name, count(*) AS n", 10**18),
])
def test_a_crowd_is_counted_without_its_pairs(spark, text, want):
    """A million leaves of one hub: 10^12 pairs would take hours."""
    leaves = spark.range(10**6)
    nodes = lambda df, kind: NodeTable(df.select("id", F.array(F.lit(kind)).alias("kinds"), F.lit("x").alias("name")), frozenset([kind]))
    edge = lambda base, to: leaves.select((F.col("id") + base).alias("id"), F.col("id").alias("src"), to.cast("bigint").alias("dst"))
    graph = Graph(spark, [nodes(leaves, "Leaf"), nodes(spark.range(-1, 0), "Hub"), nodes(spark.range(2 * 10**6, 3 * 10**6), "Place")], {"IN": edge(10**9, F.lit(-1)), "AT": edge(2 * 10**9, F.col("id") + 2 * 10**6)})
    stop = threading.Timer(120, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        assert graph.query(text).first().n == want
    finally:
        stop.cancel()
