"""Queries of the subpackage against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from siltbed.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    out = queries.queries()[name](spark, FOLDER)
    columns = sorted(out.columns)
    sql = con.sql(queries.oracle_sql()[name])
    assert columns == sorted(sql.columns)
    cells = lambda rows: sorted(tuple(str(x) for x in r) for r in rows)
    assert cells(out.select(*columns).collect()) == cells(sql.select(*columns).fetchall())
