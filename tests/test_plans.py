"""What plans must look like: filters at the scan, few columns, no products where a key exists."""

import pytest

from weftgraph.queries import commerce_graph, queries

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def graph(spark):
    return commerce_graph(spark, SF)


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(queries()["property_equals"](spark, SF))
    assert "EqualTo(c_mktsegment,BUILDING)" in text
    assert "ReadSchema: struct<c_name:string,c_mktsegment:string>" in text
    assert text.count("Scan parquet") - text.count("(1) Scan parquet ") <= 1


def test_only_tables_of_the_pattern_are_read(graph):
    text = plan(graph.query("MATCH (c:Customer)-[:PLACED]->(o) RETURN c.mktsegment AS seg, count(o) AS n"))
    assert "orders.parquet" in text and "lineitem.parquet" not in text
    # The far node adds nothing but its id, so only edges and customers are scanned.
    assert text.count("Location: InMemoryFileIndex") == 2


def test_equality_over_components_is_an_equi_join(spark):
    text = plan(queries()["equi_components"](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "HashJoin" in text or "SortMergeJoin" in text


@pytest.mark.parametrize(("name", "kind"), [("pattern_exists", "LeftSemi"), ("pattern_not_exists", "LeftAnti"), ("collect_anti_join", "LeftAnti"), ("optional_match", "LeftOuter")])
def test_join_kinds(spark, name, kind):
    text = plan(queries()[name](spark, SF))
    assert kind in text and "Python" not in text


def test_top_k_is_not_a_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(queries()["order_limit"](spark, SF))


def test_ids_reach_the_scan(graph):
    for text in ("MATCH (c:Customer) WHERE id(c) = 3000000000007 RETURN c.name AS n", "MATCH (c:Customer) WHERE id(c) IN [3000000000007, 3000000000009] RETURN c.name AS n"):
        made = graph.query(text)
        assert "c_custkey" in (pushed := next(line for line in plan(made).splitlines() if "PushedFilters" in line)) and ("EqualTo" in pushed or "In(" in pushed)
        assert made.count() == text.count("30000")


def test_derived_edges_are_written_once(graph):
    text = plan(graph.query("MATCH (o:Order)-[:CONTAINS]->(p:Part) WHERE p.size < 5 RETURN count(*) AS n"))
    assert "lineitem.parquet" not in text and "saved-" in text
