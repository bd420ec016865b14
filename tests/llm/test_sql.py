"""Queries with SQL against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["op5_secret_scan", "op6_line_dedup"])
def test_same_rows(llm_spark, name):
    df = entry.queries()[name](llm_spark, SF)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    order = [d[0] for d in cur.description]
    assert sorted(map(tuple, df.select(*order).collect()), key=str) == sorted(cur.fetchall(), key=str)
