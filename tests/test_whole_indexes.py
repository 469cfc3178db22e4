"""Index queries over all orders, not over a prefix of their keys."""

import pytest

from keyloom.plans import catalog

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", ["index_duplicates", "index_unindex"])
def test_whole_table(spark, sf, name):
    got = sorted(tuple(r) for r in catalog.QUERIES[name](spark, sf).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{sf}/orders.parquet')")
    assert got == sorted(con.execute(catalog.ORACLE_SQL[name]).fetchall()) and max(t for _, t in got) >= 50
