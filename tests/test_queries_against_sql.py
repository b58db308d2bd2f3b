"""Every registered query with SQL gives the same rows as that SQL on DuckDB, at the smallest scale."""

from __future__ import annotations

import os

import pytest
from compare import connect, difference, spark_rows, sql_rows

import __spark_entry__ as entry_points

FOLDER = os.environ.get("FLEETWATCH_DATA", "/root/testdata/sf0.001")
QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    con = connect(FOLDER)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = spark_rows(QUERIES[name](spark, FOLDER))
    if name in SQL:
        assert difference(found, sql_rows(duck, SQL[name])) is None
    else:
        assert found[1]


def test_flagship_query(spark):
    found = {r["label_status"]: r["n_rows"] for r in entry_points.entry(spark).collect()}
    assert found == {
        "positive": 20,
        "negative": 122,
        "negative_before_later_failure": 53,
        "insufficient_followup": 187,
    }
