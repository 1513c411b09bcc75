"""The queries that have SQL, against another engine on the smallest tables."""

import glob
import os

import duckdb
import pytest

from strandlake.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def sql(small):
    connection = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        connection.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, sql, small, name):
    want = sql.sql(ORACLE_SQL[name])
    found = QUERIES[name](spark, small)
    assert sorted(found.columns) == sorted(want.columns)
    rows = sorted(map(tuple, found.select(*want.columns).collect()))
    assert rows and rows == sorted(want.fetchall())
