"""Every registered query against its SQL, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from suite.verify import TABLES, differences, sorted_result

@pytest.fixture(scope="module")
def db(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sf, db, name):
    result = entry.queries()[name](spark, sf)
    got = sorted_result(result.columns, [tuple(r) for r in result.collect()])
    assert got[0]
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        cursor = db.execute(sql)
        want = sorted_result([c[0] for c in cursor.description], cursor.fetchall())
        assert differences(got, want, 1e-12) == []


def test_entry(spark):
    trace = entry.entry(spark).collect()
    assert trace and trace[-1]["total_rows"] == 6000


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
