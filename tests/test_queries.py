import glob
import os

import duckdb
import pandas as pd
import pytest

from graphloom.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(df):
    df = df[sorted(df.columns)].astype(object)
    clean = lambda x: None if x is None or (isinstance(x, float) and pd.isna(x)) else round(float(x), 6) if isinstance(x, float) else x.item() if hasattr(x, "item") else x
    return sorted(tuple(map(clean, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_as_sql(spark, sf, db, name):
    got, want = QUERIES[name](spark, sf).toPandas(), db.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
