"""Free-form properties are read once a row, and edges only where a query walks them."""

import pytest

from weftgraph.queries import queries
from weftgraph.sources.documents import free_graph

SF = "/root/testdata/sf0.001"
SCHEMAS = "id long, kinds array<string>, properties string", "id long, src long, dst long, kind string, properties string"


@pytest.mark.parametrize("name", ["json_text_list", "json_number_equals", "json_arithmetic", "json_number_order", "json_type_mismatch", "json_group"])
def test_a_property_is_read_once(spark, name):
    text = queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("from_json(MapType(StringType,StringType") == 1 and text.count("jsonObjectKeys") == 1
    # No shuffle of the nodes with all their properties.
    assert "first(" not in text and "Aggregate [id" not in text


def test_edges_are_made_when_they_are_walked(spark):
    made = []

    def edges():
        made.append(1)
        return spark.createDataFrame([(10, 1, 2, "R", None), (11, 1, 2, "R", None), (12, 2, 9, "S", None)], SCHEMAS[1])

    nodes = spark.createDataFrame([(1, ["A"], '{"n": 1.5, "s": null}'), (2, ["A", "B"], '{"n": "1", "s": {"x": [1]}}'), (3, ["B"], "no JSON"), (4, ["B"], None), (2, ["A", "B"], '{"n": "1", "s": {"x": [1]}}')], SCHEMAS[0])
    graph = free_graph(nodes, edges)
    got = {r.id: (r.n, r.s, r.gone) for r in graph.query("MATCH (a) RETURN id(a) AS id, a.n AS n, a.s IS NULL AS s, a.none AS gone").collect()}
    assert got == {1: ("1.5", True, None), 2: ("1", False, None), 3: (None, True, None), 4: (None, True, None)} and not made
    assert graph.query("MATCH (a)-[r]->(b) RETURN count(*) AS n").first().n == 1 and sorted(graph.edge_tables) == ["R"] and made == [1]


def test_both_readings_agree(spark):
    """The values of single properties are those of the map of all."""
    texts = ['{"a": 1.0, "b": "x"}', '{"a": 1e3, "b": [1, "y"]}', '{"a": null}', '{"b": {"c": 1}}', "{}", "[1]", "{", None, '{"a": true, "b": false}', '{"a": -0.50, "b": ""}', '{"a": 9007199254740993}']
    graph = free_graph(spark.createDataFrame([(i, ["A"], t) for i, t in enumerate(texts)], SCHEMAS[0]), spark.createDataFrame([], SCHEMAS[1]))
    one = {r.id: (r.p_0, r.p_1) for r in graph.nodes((), ("a", "b")).collect()}
    whole = {r.id: (r.props.get("a"), r.props.get("b")) for r in graph.node_tables[0].df.collect()}
    assert one == whole and len(one) == len(texts)
