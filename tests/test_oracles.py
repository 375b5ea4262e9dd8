"""Every query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from siltbed.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "-"
    if isinstance(x, bool):
        return str(x)
    return repr(round(float(x), 6) + 0.0) if isinstance(x, (int, float)) else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    out = catalogue.queries()[name](spark, FOLDER)
    columns = sorted(out.columns)
    sql = duck.sql(catalogue.oracle_sql()[name])
    assert columns == sorted(sql.columns)
    mine = sorted(tuple(map(cell, r)) for r in out.select(*columns).collect())
    theirs = sorted(tuple(map(cell, r)) for r in sql.select(*columns).fetchall())
    assert mine == theirs


def test_entry_has_rows(spark):
    assert catalogue.flagship(spark, FOLDER).limit(1).count() == 1
