"""Rows that an order leaves open stand as they do in the table, as SQL on one thread gives them; stored structures are folded once."""

import duckdb
import pytest

from catlas.plans import catalog_queries


@pytest.mark.parametrize("flags", ["NR", "RN"])
def test_parameters_of_one_number(spark, tmp_path, flags):
    parts = [(1, 5, 10.0, "p")]  # a procedure
    lines = [(1, 7, 3, 1.0, f, "F") for f in flags] + [(1, 7, 2, 1.0, "N", "F")]
    spark.createDataFrame(parts, "p_partkey long, p_size int, p_retailprice double, p_name string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_partkey long, l_orderkey long, l_linenumber int, l_extendedprice double, l_returnflag string, l_linestatus string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect(config={"threads": 1})
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    [(_, _, want)] = con.execute(catalog_queries.ORACLE_SQL["module_catalog_rows"]).fetchall()
    [got] = catalog_queries.module_catalog_rows(spark, str(tmp_path)).collect()
    assert got["line"] == want and ("@p3 int out, @p3 int" in want) == (flags == "RN")


def test_pulls_read_structures_that_are_folded_once(spark, monkeypatch):
    read = []
    monkeypatch.setattr(catalog_queries.fetching.Store, "add", lambda self, entries: read.append(entries.inputFiles()))
    catalog_queries.stored_structures(spark, "/root/testdata/sf0.001")
    assert len(read) == 2 and not any("lineitem" in f for files in read for f in files)
