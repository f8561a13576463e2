"""Registered queries with a statement, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from garimpo.llm.oracles import ORACLES
from garimpo.llm.queries import QUERIES


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, data, name):
    got = QUERIES[name](spark, data)
    rows = sorted(tuple(str(r[c]) for c in sorted(got.columns)) for r in got.collect())
    if name in ORACLES:
        want = db.sql(ORACLES[name])
        at = [want.columns.index(c) for c in sorted(got.columns)]
        assert sorted(got.columns) == sorted(want.columns)
        assert rows == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())
