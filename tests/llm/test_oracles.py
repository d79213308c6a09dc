"""Queries with SQL, on whole tables, against DuckDB."""

import os

import duckdb
import pytest

from quillrank.llm import queries

D = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "benchmark")


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    b = con.sql(queries.ORACLES[name])
    a = queries.QUERIES[name](spark, D).select(b.columns)
    assert sorted(map(tuple, a.collect())) == sorted(b.fetchall())
