"""Every query with SQL gives what DuckDB gives on the same small tables."""

import os

import duckdb
import pytest

from corvane.queries import QUERIES, SQL

SF = os.environ.get("CORVANE_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rows = sorted(repr(tuple(r)) for r in df.select(*names).collect())
    assert rows or name in SQL
    if name in SQL:
        assert rows == sorted(map(repr, duck.sql(f"select {', '.join(names)} from ({SQL[name]})").fetchall()))
