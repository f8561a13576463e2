"""Every core query with a statement against DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from garimpo.catalogue import ORACLES, QUERIES


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6)
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")
        df[c] = df[c].map(lambda v: "" if v is None or v is pd.NaT or v is pd.NA or v != v else "=" + str(v.item() if hasattr(v, "item") else v))
    return sorted(map(tuple, df.values.tolist())), list(df.columns)


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, data, name):
    got = QUERIES[name](spark, data).toPandas()
    if name in ORACLES:
        assert plain(got) == plain(db.sql(ORACLES[name]).df())
