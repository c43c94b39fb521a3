"""Every query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from catlas.plans import catalog_queries, oracles, queries

QUERIES = queries.QUERIES | catalog_queries.QUERIES
ORACLE_SQL = oracles.ORACLE_SQL | catalog_queries.ORACLE_SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def rounded(v):
    return f"{v:.9g}" if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    want = duck.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    places = [want.columns.index(c) for c in columns]
    assert sorted(tuple(rounded(r[c]) for c in columns) for r in rows) == sorted(tuple(rounded(r[i]) for i in places) for r in want.fetchall())


ORDERED = {"dropped": ["key"], "narrow": ["schema", "name"], "sqlserver_manifest": ["schema", "name"], "local_manifest": ["key"], "catalog_merge": ["kind", "key"]}


@pytest.mark.parametrize("name", list(ORDERED))
def test_rows_come_in_order(spark, name):
    """Bytewise, as the code points of the keys."""
    df = QUERIES[name](spark, DATA)
    kept = [c for c in ORDERED[name] if c in df.columns]
    got = [tuple(r[c].encode() for c in kept) for r in df.collect()]
    assert kept and got and got == sorted(got)
