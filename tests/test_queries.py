"""Every query with SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from quillrank.plans import base, generations, graph, indexes, mining, more, recall, retrieval, stored, texts  # noqa: F401

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", sorted(base.ORACLES))
def test_oracle(spark, con, name):
    a, b = base.QUERIES[name](spark, D).toPandas(), con.sql(base.ORACLES[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    plain = lambda df: sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))
    assert plain(a) == plain(b)
