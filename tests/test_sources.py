"""Documents, snapshots and the change log."""

import json

import pytest

from weftgraph.errors import UnsupportedQuery
from weftgraph.sources.documents import document_graph, read_document, resolve_edges
from weftgraph.sources.snapshot import load_graph, save_graph
from weftgraph.streaming import changelog as C

DOCUMENT = {
    "metadata": {"source_kind": "Base"},
    "graph": {
        "nodes": [
            {"id": "u1", "kinds": ["User"], "properties": {"name": "ann", "objectid": "U1", "n": 1, "mails": ["a"]}},
            {"id": "u2", "kinds": ["User", "Owner"], "properties": {"name": "bob", "n": 2.5}},
            {"id": "t1", "kinds": ["Team"], "properties": {"name": "core", "slug": "c"}},
        ],
        "edges": [
            {"kind": "MemberOf", "start": {"value": "u1"}, "end": {"match_by": "name", "value": "core", "kind": "Team"}, "properties": {"role": "dev"}},
            {"kind": "Owns", "start": {"value": "u2"}, "end": {"match_by": "property", "property_matchers": [{"key": "slug", "operator": "equals", "value": "c"}]}},
            {"kind": "Owns", "start": {"value": "nobody"}, "end": {"value": "t1"}},
        ],
    },
}


def test_document(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps(DOCUMENT))
    nodes, edges = read_document(spark, str(tmp_path / "d.json"))
    ready, lost = resolve_edges(nodes, edges)
    assert (ready.count(), lost.count()) == (2, 1)
    graph = document_graph(spark, str(tmp_path / "d.json"))
    rows = graph.query("MATCH (u:User)-[r]->(t:Team) RETURN u.name AS u, type(r) AS r, t.name AS t").collect()
    assert sorted(map(tuple, rows)) == [("ann", "MemberOf", "core"), ("bob", "Owns", "core")]
    assert graph.query("MATCH (n:Base:Owner) WHERE n.n = 2.5 RETURN count(n) AS n").first().n == 1
    assert graph.query("MATCH ()-[r {role: 'dev'}]->() RETURN count(r) AS n").first().n == 1
    bad = {"graph": {"nodes": [{"id": "x", "kinds": ["A", "B", "C"], "properties": {}}], "edges": []}}
    (tmp_path / "bad.json").write_text(json.dumps(bad))
    with pytest.raises(UnsupportedQuery):
        read_document(spark, str(tmp_path / "bad.json"))


def test_every_matcher_of_an_end_must_fit(spark, tmp_path):
    match = lambda *pairs, op="equals": {"match_by": "property", "property_matchers": [{"key": k, "operator": op, "value": v} for k, v in pairs]}
    nodes = [{"id": f"n{i}", "kinds": ["A"], "properties": {"x": str(i % 2), "y": str(i // 2)}} for i in range(4)]
    edges = [{"kind": "R", "start": match(("x", "1"), ("y", "0")), "end": match(("x", "0"))}, {"kind": "S", "start": match(("x", "1"), ("y", "7")), "end": {"value": "n0"}}]
    (tmp_path / "m.json").write_text(json.dumps({"graph": {"nodes": nodes, "edges": edges}}))
    held, named = read_document(spark, str(tmp_path / "m.json"))
    ready, lost = resolve_edges(held, named)
    key = {r.id: r.key for r in held.collect()}
    assert sorted((key[r.src], key[r.dst]) for r in ready.collect()) == [("n1", "n0"), ("n1", "n2")] and lost.count() == 1
    edges[0]["start"] = match(("x", "1"), op="contains")
    (tmp_path / "m.json").write_text(json.dumps({"graph": {"nodes": nodes, "edges": edges}}))
    with pytest.raises(UnsupportedQuery):
        resolve_edges(*read_document(spark, str(tmp_path / "m.json")))


def test_snapshot(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps(DOCUMENT))
    graph = document_graph(spark, str(tmp_path / "d.json"))
    lineage = save_graph(graph, f"file://{tmp_path}/s")
    again = load_graph(spark, f"file://{tmp_path}/s", lineage)
    assert again.query("MATCH (n:User) RETURN count(n) AS n").first().n == 2
    with pytest.raises(UnsupportedQuery, match="lineage"):
        load_graph(spark, f"file://{tmp_path}/s", "other")
    (tmp_path / "s" / "manifest.json").unlink()
    with pytest.raises(UnsupportedQuery, match="manifest"):
        load_graph(spark, f"file://{tmp_path}/s")


NODES = "id long, kinds array<string>, properties string"
EDGES = "id long, src long, dst long, kind string, properties string"


@pytest.fixture
def base(spark):
    nodes = spark.createDataFrame([(1, ["A"], '{"objectid":"x","p":1}'), (2, ["B"], '{"objectid":"y"}')], NODES)
    edges = spark.createDataFrame([(10, 1, 2, "R", None)], EDGES)
    return nodes, edges


def test_merge_on_read_and_fold(spark, base, tmp_path):
    nodes, edges = base
    log = C.put_nodes(spark.createDataFrame([(3, ["A"], "{}")], NODES), 1)
    log = log.union(C.put_edges(spark.createDataFrame([(11, 2, 3, "R", None), (12, 1, 9, "R", None)], EDGES), 2))
    log = log.union(C.delete_edges(spark.createDataFrame([(10,)], "id long"), 3))
    live, walked = C.merged_view(nodes, edges, log)
    assert sorted(r.id for r in live.collect()) == [1, 2, 3]
    assert [r.id for r in walked.collect()] == [11]
    assert [r.id for r in C.pending_edges(nodes, log).collect()] == [12]
    # Deleting a node deletes its edges; putting it again doesn't bring them back.
    gone = log.union(C.delete_nodes(spark.createDataFrame([(3,)], "id long"), 4))
    assert C.merged_view(nodes, edges, gone)[1].count() == 0
    back = gone.union(C.put_nodes(spark.createDataFrame([(3, ["A"], "{}")], NODES), 5))
    assert C.merged_view(nodes, edges, back)[1].count() == 0
    again = back.union(C.put_edges(spark.createDataFrame([(11, 2, 3, "R", None)], EDGES), 6))
    for log_of in (again, C.merge_segments(again.where("seq < 5"), again.where("seq >= 5"))):
        assert C.differences(C.merged_view(nodes, edges, log_of)[1], walked) == 0
    assert C.merged_view(nodes, edges, C.merge_segments(back.where("seq < 5"), back.where("seq >= 5")))[1].count() == 0
    left = C.fold(nodes, edges, log, f"file://{tmp_path}/base")
    (tmp_path / "base" / "fold-99999999999999999999-broken").mkdir()  # a fold that stopped before its manifest
    folded = C.folded(spark, f"file://{tmp_path}/base")[:2]
    late = left.union(C.put_nodes(spark.createDataFrame([(9, ["B"], "{}")], NODES), 6))
    assert sorted(r.id for r in C.merged_view(*folded, late)[1].collect()) == [11, 12]
    half = C.merge_segments(log.where("seq < 2"), log.where("seq >= 2"))
    assert C.differences(C.merged_view(nodes, edges, half)[1], walked) == 0


def test_fold_drops_edges_put_to_a_node_that_is_gone(spark, base, tmp_path):
    nodes, edges = base
    log = C.delete_nodes(spark.createDataFrame([(2,)], "id long"), 1)
    log = log.union(C.put_edges(spark.createDataFrame([(12, 1, 9, "R", None), (13, 1, 2, "R", None), (14, 2, 9, "R", None)], EDGES), 2))
    assert [r.id for r in C.fold(nodes, edges, log, f"file://{tmp_path}/base").collect()] == [12]


def test_upserts_and_kind_deletes(spark, base):
    nodes, edges = base
    rows = spark.createDataFrame([(["C"], '{"objectid":"x","q":2}'), (["D"], '{"objectid":"z"}')], "kinds array<string>, properties string")
    live, _ = C.merged_view(nodes, edges, C.upsert_nodes(nodes, rows, 1))
    got = {json.loads(r.properties)["objectid"]: (r.kinds, json.loads(r.properties)) for r in live.collect()}
    assert got["x"] == (["A", "C"], {"objectid": "x", "p": 1, "q": 2}) and got["z"][0] == ["D"]
    new = spark.createDataFrame([("y", "x", "R", '{"w":1}'), ("x", "y", "R", '{"w":2}')], "start_key string, end_key string, kind string, properties string")
    _, walked = C.merged_view(nodes, edges, C.upsert_edges(nodes, edges, new, 1))
    assert {(r.src, r.dst): json.loads(r.properties) for r in walked.collect()} == {(2, 1): {"w": 1}, (1, 2): {"w": 2}}
    assert [r.id for r in C.delete_nodes_by_kinds(nodes, 2, ["A", "B"], ["B"]).collect()] == [1]
    assert C.delete_edges_by_kinds(edges, 2, ["R"]).count() == 1


def test_upserts_of_repeated_keys(spark, base):
    nodes, edges = base
    bags = ['{"objectid":"x","a":1,"c":"first"}', '{"objectid":"x","b":{"z":[1.0,null]},"c":"second"}', '{"objectid":"x","b":{"z":[1.0,null]},"c":"second"}', '{"objectid":"z","n":null}']
    rows = spark.createDataFrame([([f"K{i}"], b) for i, b in enumerate(bags)], "kinds array<string>, properties string")
    live, _ = C.merged_view(nodes, edges, C.upsert_nodes(nodes, rows, 1))
    got = {json.loads(r.properties)["objectid"]: (sorted(r.kinds), json.loads(r.properties)) for r in live.collect()}
    # In the order of their text the bag with "a" is first.
    assert got["x"] == (["A", "K0", "K1", "K2"], {"objectid": "x", "p": 1, "a": 1, "b": {"z": [1.0, None]}, "c": "second"})
    assert got["z"] == (["K3"], {"objectid": "z", "n": None}) and len(got) == 3
    new = [("x", "y", "R", '{"w":1,"v":1}'), ("x", "y", "R", '{"u":2,"w":0}'), ("x", "y", "R", None), ("y", "x", "R", None)]
    new = spark.createDataFrame(new, "start_key string, end_key string, kind string, properties string")
    _, walked = C.merged_view(nodes, edges, C.upsert_edges(nodes, edges, new, 1))
    assert {(r.id, r.src, r.dst): json.loads(r.properties) for r in walked.collect() if r.id == 10} == {(10, 1, 2): {"u": 2, "v": 1, "w": 1}}
    assert sorted((r.src, r.dst) for r in walked.collect()) == [(1, 2), (2, 1)]


def test_follow_stream(spark, base, tmp_path):
    C.put_nodes(spark.createDataFrame([(3, ["A"], "{}")], NODES), 1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(C.CHANGE).parquet(f"{tmp_path}/in")
    for _ in range(2):  # nothing new the second time
        C.follow(stream, f"{tmp_path}/log", f"{tmp_path}/state").awaitTermination()
    graph = C.merged_graph(*base, C.read_log(spark, f"{tmp_path}/log"))
    assert graph.query("MATCH (n:A) RETURN count(n) AS n").first().n == 2
