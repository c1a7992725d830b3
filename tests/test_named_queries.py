"""Every named query against its SQL twin, and never on an empty answer alone."""

from pathlib import Path

import duckdb
import pytest

from weftgraph import queries

DATA = Path("/root/testdata/sf0.001")
EMPTY = {"equi_components", "concat_equality", "scan_all_of_kinds", "hop1_in", "suffix", "varlen_mixed_chain"}
SLOW = [n for n in queries.queries() if n.startswith(("shortest", "varlen_path", "builder_shortest"))]
QUICK = [n for n in queries.queries() if n not in SLOW]


@pytest.fixture(scope="module")
def sql():
    db = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return db


def check(spark, sql, name):
    df = queries.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    want = sorted(sql.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall(), key=str)
    assert got == want
    assert got or name in EMPTY


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, sql, name):
    check(spark, sql, name)


@pytest.mark.parametrize("name", SLOW)
def test_search(spark, sql, name):
    check(spark, sql, name)
