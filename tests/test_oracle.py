"""Every query that has SQL agrees with it on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from cairn.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
            return ""
        return f"{float(x):.6f}" if isinstance(x, (int, float, np.number)) and not isinstance(x, (bool, np.bool_)) else str(x)

    return sorted(tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, db, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), db.execute(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_costs_that_end_in_half_a_cent(spark, tmp_path):
    """Both engines round a cost alike, also where its decimals are a tie."""
    balances = [x / 2 for x in range(-3, 20000, 7)] + [6797.5, 3810.5, 8136.5, 7183.5]
    customers = pd.DataFrame({"c_custkey": range(len(balances)), "c_name": "x", "c_nationkey": 0, "c_acctbal": balances, "c_mktsegment": "BUILDING"})
    customers.to_parquet(tmp_path / "customer.parquet")
    theirs = duckdb.execute(ORACLE_SQL["resumed_grid"].replace("customer", "customers")).df()
    assert rows(QUERIES["resumed_grid"](spark, str(tmp_path)).toPandas()) == rows(theirs)
