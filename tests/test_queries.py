"""Registered queries against their SQL in DuckDB at the smallest scale."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from sessionloom.plans.queries import ORACLE_SQL, QUERIES

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"create view {p.stem} as from '{p}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("null" if v is None or v is pd.NA or v != v else f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in df.astype(object).itertuples(index=False))


@pytest.mark.skipif(not SF.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, db, name):
    got, want = rows(QUERIES[name](spark, str(SF)).toPandas()), rows(db.sql(ORACLE_SQL[name]).df())
    assert len(got) == len(want)
    # Sums in another order may round differently in the last of six places.
    for a, b in zip(got, want, strict=True):
        assert a == b or all(x == y or abs(float(x) - float(y)) < 3e-5 for x, y in zip(a, b, strict=True))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
