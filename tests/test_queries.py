"""Every query of the warehouse against its SQL in DuckDB, at the smallest size."""

import collections

import duckdb
import pytest

from millrace import queries, source_queries  # noqa: F401  (adds queries)

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, oracle, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = collections.Counter(tuple(r[c] for c in columns) for r in df.collect())
    cursor = oracle.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == collections.Counter(tuple(r[i] for i in at) for r in cursor.fetchall())
