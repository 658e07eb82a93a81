"""Every registered query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from frameloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    if hasattr(value, "tolist") and not isinstance(value, str):
        value = value.tolist()
    if value is None or value is pd.NA or value != value:
        return "-"
    if isinstance(value, float):
        return f"{value:.6f}".rstrip("0").rstrip(".")
    return str(value)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    ours = catalog.QUERIES[name](spark, FOLDER).toPandas()
    theirs = duck.execute(catalog.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(ours) == rows(theirs)
