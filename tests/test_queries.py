"""Each engine query against its SQL in another engine, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from strandlake.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def sql(small):
    connection = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        connection.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def _plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, float) and not value.is_integer():
        return round(value, 9)
    return int(value) if not (isinstance(value, float) and math.isnan(value)) else "nan"


def _rows(names, rows):
    return names, sorted((tuple(map(_plain, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, sql, small, name):
    found = QUERIES[name](spark, small)
    names = sorted(found.columns)
    want = sql.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == names
    assert _rows(names, found.select(*names).collect()) == _rows(names, want.select(*names).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_others_run(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 600
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
