"""Value semantics on free-form properties, refusals, patterns and paths against brute force."""

import itertools
import random

import pytest

from weftgraph.builder import end_ids, end_kinds, node_ids, node_kinds, node_property, rel_kinds, start_ids, start_kinds
from weftgraph.errors import UnsupportedQuery
from weftgraph.plans.parser import parse
from weftgraph.sources.documents import free_graph

NODES = [
    (1, ["A"], '{"s": "x", "n": 5, "f": true, "l": ["a", "b"]}'),
    (2, ["A", "B"], '{"s": "5", "n": 5.0, "l": []}'),
    (3, ["B"], '{"s": null, "n": "5"}'),
    (4, ["C"], "{}"),
    (5, ["C"], '{"s": "a%b_c", "n": -2.5, "f": false, "l": ["b"], "o": {"k": 1}}'),
    (6, ["A"], '{"s": 12345, "n": 9007199254740993}'),
]
EDGES = [(10, 1, 2, "R", None), (11, 2, 3, "R", None), (12, 3, 1, "R", None), (13, 1, 1, "S", None), (14, 1, 3, "S", '{"w": 2}'), (15, 4, 5, "S", None)]


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame(NODES, "id long, kinds array<string>, properties string")
    edges = spark.createDataFrame(EDGES, "id long, src long, dst long, kind string, properties string")
    out = free_graph(nodes, edges, now=1_000_000)
    out.node_tables[0].df.cache()
    return out


def ids(graph, condition):
    return sorted(r[0] for r in graph.query(f"MATCH (n) WHERE {condition} RETURN id(n) AS id").collect())


@pytest.mark.parametrize(
    ("condition", "want"),
    [
        ("n.s = 'x'", [1]),
        ("n.s <> 'x'", [2, 3, 5, 6]),  # absent is unknown, another type is unlike
        ("n.n = 5", [1, 2]),
        ("n.s = '5'", [2]),
        ("n.s = null", []),
        ("n.n = -2.5", [5]),
        ("n.f = true", [1]),
        ("n.l = ['a', 'b']", [1]),
        ("n.s IS NULL", [3, 4]),
        ("n.s IS NOT NULL", [1, 2, 5, 6]),
        ("n.s IN ['x', '12345']", [1, 6]),
        ("'b' IN n.l", [1, 5]),
        ("n.s STARTS WITH 'a%'", [5]),
        ("NOT n.s CONTAINS 'x'", [2, 3, 4, 5, 6]),  # absent counts as empty under NOT
        ("coalesce(n.s, '') CONTAINS '%'", [1, 2, 3, 4, 5, 6]),  # LIKE: the needle is a wildcard
        ("coalesce(n.s, 'none') = 'none'", [3, 4]),
        ("n.s =~ '(?i)^X$'", [1]),
        ("n:A AND NOT n:B", [1, 6]),
        ("n:A OR n:C", [1, 2, 4, 5, 6]),
        ("(n)-[:R]->()", [1, 2, 3]),
        ("NOT (n)-[:R]->()", [4, 5, 6]),
        ("(n)-[:S]->(:C) OR n.s = 'x'", [1, 4]),
        ("id(n) IN [1, 4]", [1, 4]),
        ("size(n.l) = 2", [1]),
        ("datetime().epochseconds = 1000000 AND id(n) = 1", [1]),
        ("toUpper(n.s) = 'X'", [1]),
        ("'<' + n.s = '<12345'", [6]),
    ],
)
def test_conditions(graph, condition, want):
    assert ids(graph, condition) == want


def test_bad_cast_aborts(graph):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        ids(graph, "n.s < 5")


def test_undirected_optional_and_paths(graph):
    rows = graph.query("MATCH (a:A)-[r:R]-(b) RETURN id(a) AS a, id(b) AS b").collect()
    assert sorted((r.a, r.b) for r in rows) == [(1, 2), (1, 3), (2, 1), (2, 3)]
    rows = graph.query("MATCH (c:C) OPTIONAL MATCH (c)-[:S]->(x) RETURN id(c) AS c, id(x) AS x").collect()
    assert sorted(map(tuple, rows), key=str) == [(4, 5), (5, None)]
    rows = graph.query("MATCH p = (a)-[:R*2..2]->(b) RETURN nodes(p) AS n, relationships(p) AS e").collect()
    assert sorted(map(tuple, rows)) == [([1, 2, 3], [10, 11]), ([2, 3, 1], [11, 12]), ([3, 1, 2], [12, 10])]
    assert graph.query("MATCH (a)-[r {w: 2}]->(b) RETURN id(r) AS r").first().r == 14
    # Each edge once in a pattern: going there and back over one edge is no match.
    assert graph.query("MATCH (a:C)-[:S]->(b)<-[:S]-(c) RETURN count(*) AS n").first().n == 0
    # A collection is a set of nodes.
    assert graph.query("MATCH (a)-[:R]->(b) WITH collect(b) AS seen MATCH (n:A) WHERE NOT n IN seen RETURN id(n) AS id").first().id == 6


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        ("MATCH (n) RETURN $x AS x", "params"),
        ("MATCH (n) RETURN sum(n.n) AS s", "unsupported"),
        ("UNWIND [1] AS x RETURN x AS x", "unsupported"),
        ("MATCH (n) WHERE n.f XOR n.f RETURN n", "unsupported"),
        ("MATCH (a)-[r]->(b) WHERE r.w = 2 RETURN id(a) AS a", "unsupported"),
        ("MATCH (a)-[*1..2]-(b) RETURN count(*) AS n", "unsupported"),
        ("MATCH (n:Nowhere) RETURN n", "unknown_kind"),
        ("MATCH p = shortestPath((a:A)-[:R*1..]->(b:B)) RETURN p", "self_endpoint"),
    ],
)
def test_strict_refusals(graph, text, reason):
    with pytest.raises(UnsupportedQuery) as refused:
        graph.query(text, strict=True)
    assert refused.value.reason == reason


@pytest.mark.parametrize("text", ["MATCH (n) WHERE 1 < n.x < 5 RETURN n", "MATCH (a)-[*..0]->(b) RETURN a", "CREATE (n)", "MATCH (n", "RETURN 'a"])
def test_parse_refusals(text):
    with pytest.raises(UnsupportedQuery):
        parse(text)


def random_graph(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(9), rng.randrange(9), rng.choice("RS")) for _ in range(18)}
    rows = [(100 + i, a, b, k, None) for i, (a, b, k) in enumerate(sorted(edges))]
    nodes = [(i, ["N"] + (["E"] if i % 2 else []), '{"i": %d}' % i) for i in range(9)]
    graph = free_graph(spark.createDataFrame(nodes, "id long, kinds array<string>, properties string"), spark.createDataFrame(rows, "id long, src long, dst long, kind string, properties string"))
    return graph, rows


def brute_trails(rows, start, kinds, high):
    out, level = [], [((), start)]
    for _ in range(high):
        level = [((*t, e[0]), e[2]) for t, end in level for e in rows if e[1] == end and e[3] in kinds and e[0] not in t]
        out += [(start, end, list(t)) for t, end in level]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_trails_and_shortest_against_brute_force(spark, seed):
    graph, rows = random_graph(spark, seed)
    want = sorted(x for s in range(0, 9, 4) for x in brute_trails(rows, s, "RS", 3))
    got = graph.query("MATCH p = (a)-[*1..3]->(b) WHERE a.i IN [0, 4, 8] RETURN id(a) AS a, id(b) AS b, relationships(p) AS e").collect()
    assert sorted((r.a, r.b, r.e) for r in got) == want and want
    # All shortest paths of each pair, and one of each.
    best = {}
    for s, t in itertools.product((0, 2, 4), (1, 3)):
        found = [x for x in brute_trails(rows, s, "RS", 5) if x[1] == t]
        if found:
            least = min(len(x[2]) for x in found)
            best[s, t] = sorted(x[2] for x in found if len(x[2]) == least)
    text = "MATCH p = {}((a)-[*1..5]->(b)) WHERE a.i IN [0, 2, 4] AND b.i IN [1, 3] RETURN id(a) AS a, id(b) AS b, relationships(p) AS e"
    got = graph.query(text.format("allShortestPaths")).collect()
    assert sorted((r.a, r.b, r.e) for r in got) == sorted((s, t, e) for (s, t), es in best.items() for e in es)
    one = graph.query(text.format("shortestPath")).collect()
    assert {(r.a, r.b): len(r.e) for r in one} == {k: len(v[0]) for k, v in best.items()} and len(one) == len(best)
    assert all(r.e in best[r.a, r.b] for r in one)


def test_builder(graph):
    nodes, rels = graph.builder().nodes(), graph.builder().relationships()
    assert nodes.filter(node_kinds("A", "B")).count() == 4
    assert nodes.filter(node_kinds("A"), node_kinds("B")).count() == 1
    assert [r.id for r in nodes.filter(node_ids(3, 1)).fetch_ids().collect()] == [1, 3]
    assert [r.id for r in nodes.filter(node_property("s", "=", "x")).fetch_kinds().collect()] == [1]
    assert rels.filter(rel_kinds("R")).count() == 3
    assert sorted(r.id for r in rels.filter(start_ids(1), end_kinds("A")).fetch_ids().collect()) == [10, 13]
    assert [tuple(r) for r in rels.filter(start_kinds("C")).fetch_triples().collect()] == [(15, 4, 5)]
    step = rels.filter(start_ids(1), rel_kinds("S")).fetch_step().collect()
    assert [(r.node_id, r.rel_id, r.rel_kind) for r in step] == [(1, 13, "S"), (3, 14, "S")]
    paths = rels.filter(start_ids(2), end_ids(1)).fetch_all_shortest_paths().collect()
    assert [(r.nodes, r.edges) for r in paths] == [([2, 3, 1], [11, 12])]
    with pytest.raises(UnsupportedQuery):
        nodes.filter(node_kinds()).count()


STRICT = {
    "MATCH (c:Customer) RETURN c.name AS n ORDER BY n": "collation",
    "MATCH (c:Customer) WHERE c.name < c.mktsegment RETURN id(c) AS i": "collation",
    "MATCH (c:Customer) WHERE c.name =~ '.*\\\\d' RETURN id(c) AS i": "unsupported",
    "MATCH (c:Customer) WHERE c.name =~ '(?s)x' RETURN id(c) AS i": "unsupported",
    "MATCH (c:Customer) WHERE c.name =~ 'x{300}' RETURN id(c) AS i": "unsupported",
    "MATCH (c:Customer) WHERE c.name =~ '[[:alpha:]]' RETURN id(c) AS i": "unsupported",
    "MATCH (n:Nation) OPTIONAL MATCH (n)<-[:IN_NATION]-(c)-[:PLACED]->(o) RETURN id(n) AS i": "unsupported",
    "MATCH (n:Nation) OPTIONAL MATCH (m:Region) RETURN id(n) AS i": "unsupported",
    "MATCH (n:Nation) OPTIONAL MATCH (n)-[:IN_REGION]->(r) RETURN id(n) AS i ORDER BY i": "unsupported",
    "MATCH (n:Nation) WITH n, null AS x RETURN id(n) AS i": "unsupported",
    "MATCH (n:Nation) WITH n, true AS x RETURN id(n) AS i": "unsupported",
    "MATCH (n:Nation) WITH 'a' AS x RETURN x": "unsupported",
    "MATCH (p:Part) WHERE 5 = p.size RETURN id(p) AS i": "unsupported",
    "MATCH (p:Part) WHERE p.size = -5 RETURN id(p) AS i": "unsupported",
    "MATCH (p:Part) RETURN p.size + 1 AS s": "unsupported",
    "MATCH (p:Part) RETURN 1 AS s": "unsupported",
    "MATCH (a:Region)-[:IN_REGION]-(b)-[:IN_NATION]-(c) RETURN id(a) AS i": "unsupported",
    "MATCH (n:Nation) MATCH (n) RETURN id(n) AS i": "unsupported",
    "MATCH (p:Part) WHERE p.size + p.retailprice > 7 RETURN id(p) AS i": "unsupported",
    "MATCH (p:Part) WHERE -p.size > 7 RETURN id(p) AS i": "unsupported",
    "MATCH (n:Nation)-[:IN_REGION*0..0]->(m) RETURN id(n) AS i": "unsupported",
    "MATCH (a:Region), p = shortestPath((b:Nation)-[:IN_REGION*1..]->(c:Region)) RETURN id(a) AS i": "unsupported",
    "MATCH (n:Nation) WHERE id(n) IS NULL RETURN id(n) AS i": "unsupported",
    "MATCH (p:Part) WHERE p.size IN [1, 'a'] RETURN id(p) AS i": "unsupported",
    "MATCH (p:Part) WHERE p.size IN [1, null] RETURN id(p) AS i": "unsupported",
    "MATCH (c:Customer) WHERE c.acctbal > 9234 RETURN id(c) AS i": "unsupported",
    "MATCH (c:Customer) WHERE c.acctbal IN [9234] RETURN id(c) AS i": "unsupported",
}
ANSWERED = [
    "MATCH (c:Customer) WHERE c.acctbal > 9234.5 RETURN id(c) AS i ORDER BY c.acctbal LIMIT 3",
    "MATCH (c:Customer) WHERE c.name =~ '(?i).*7' RETURN id(c) AS i",
    "MATCH (n:Nation) OPTIONAL MATCH (n)-[:IN_REGION]->(r) RETURN id(n) AS i, id(r) AS j",
    "MATCH (p:Part) WHERE p.size + 1 > 7 AND p.size IN [7, 8] RETURN id(p) AS i",
    "MATCH (a:Region)-[:IN_REGION]-(b) RETURN id(a) AS i",
]


@pytest.fixture(scope="module")
def commerce(spark):
    from weftgraph.sources.relational import commerce_graph

    return commerce_graph(spark, "/root/testdata/sf0.001")


@pytest.mark.parametrize("text", STRICT)
def test_strict_catalogue(commerce, text):
    with pytest.raises(UnsupportedQuery) as refused:
        commerce.query(text, strict=True)
    assert refused.value.reason == STRICT[text]


@pytest.mark.parametrize("text", ANSWERED)
def test_strict_answers_the_core(commerce, text):
    assert commerce.query(text, strict=True).columns


def test_numbers_are_compared_as_numbers(commerce):
    count = lambda where: commerce.query(f"MATCH (c:Customer) WHERE {where} RETURN count(c) AS n").first().n
    value = commerce.query("MATCH (c:Customer) WHERE c.acctbal > 0 RETURN c.acctbal AS b ORDER BY b DESC LIMIT 1").first().b
    whole = int(value)
    assert value != whole and count(f"c.acctbal > {whole}") == 1 and count(f"c.acctbal IN [{whole}]") == 0 and count(f"c.acctbal = {value}") == 1


def test_search_budgets(spark):
    nodes = spark.createDataFrame([(i, ["N"], "{}") for i in range(12)], "id long, kinds array<string>, properties string")
    edges = spark.createDataFrame([(100 + 12 * a + b, a, b, "R", None) for a in range(12) for b in range(12) if a != b], "id long, src long, dst long, kind string, properties string")
    graph = free_graph(nodes, edges)
    graph.budget = 100
    for text in ("MATCH (a)-[:R*1..3]->(b) RETURN count(*) AS n", "MATCH (a:N), (b:N) RETURN count(*) AS n"):
        with pytest.raises(UnsupportedQuery) as refused:
            graph.query(text).collect()
        assert refused.value.reason == "budget"
    assert graph.query("MATCH (a:N), (b:N) WHERE id(a) = id(b) RETURN count(*) AS n").first().n == 12


@pytest.mark.parametrize("seed", range(2))
def test_pruned_trails_are_all_trails(spark, seed):
    """Long ranges towards a bound or narrowed end, against plain enumeration; overall shortest paths search as one."""
    rng = random.Random(seed)
    pairs = sorted({(rng.randrange(9), rng.randrange(9)) for _ in range(14)})
    nodes = spark.createDataFrame([(i, ["S"] if i < 2 else ["T"] if i > 6 else ["N"], "{}") for i in range(9)], "id long, kinds array<string>, properties string")
    edges = spark.createDataFrame([(100 + k, a, b, "R", None) for k, (a, b) in enumerate(pairs)], "id long, src long, dst long, kind string, properties string")
    graph = free_graph(nodes, edges)

    def walk(at, used):
        yield at, len(used)
        if len(used) < 5:
            for k, (a, b) in enumerate(pairs):
                if a == at and k not in used:
                    yield from walk(b, [*used, k])

    want = sorted((s, t, n) for s in (0, 1) for t, n in walk(s, []) if t in (7, 8) and n)
    got = graph.query("MATCH p = (a:S)-[:R*1..5]->(b:T) RETURN id(a) AS a, id(b) AS b, length(p) AS n").collect()
    assert sorted(map(tuple, got)) == want
    if want:
        least = min(n for *_, n in want)
        got = graph.query("MATCH p = allShortestPaths((a:S)-[:R*1..]->(b:T)) RETURN id(a) AS a, id(b) AS b, length(p) AS n", shortest="overall").collect()
        assert sorted(map(tuple, got)) == [x for x in want if x[2] == least]


def test_paths_are_returned_whole(graph, commerce):
    got = graph.query("MATCH p = (a)-[:R*0..2]->(b) WHERE id(a) = 1 RETURN p, length(p) AS d ORDER BY d").collect()
    assert [[n.id for n in r.p.nodes] for r in got] == [[1], [1, 2], [1, 2, 3]] and [[e.id for e in r.p.edges] for r in got] == [[], [10], [10, 11]]
    last = got[-1].p
    assert [n.kinds for n in last.nodes] == [["A"], ["A", "B"], ["B"]] and last.nodes[0].props["s"] in ("x", '"x"') and [(e.src, e.dst, e.kind) for e in last.edges] == [(1, 2, "R"), (2, 3, "R")]
    assert graph.query("MATCH p = (a)-[:S]->(b) WHERE id(a) = 1 AND id(b) = 3 RETURN p").first().p.edges[0].props["w"] == "2"
    row = commerce.query("MATCH p = shortestPath((c:Customer)-[*1..3]->(r:Region)) WHERE id(c) = 3000000000003 RETURN p LIMIT 1").first().p
    assert [n.kinds[0] for n in row.nodes] == ["Customer", "Nation", "Region"] and row.nodes[0].props.name.startswith("Customer") and [e.kind for e in row.edges] == ["IN_NATION", "IN_REGION"]
