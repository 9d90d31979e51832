"""Numbered queries against their SQL in DuckDB at the smallest scale."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from sessionloom.llm.queries import ORACLE_SQL, QUERIES

SF = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SF.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"create view {p.stem} as from '{p}'")
    want = con.sql(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, str(SF)).select(*want.columns).toPandas()
    rows = lambda df: sorted(tuple(None if pd.isna(v) else int(v) if isinstance(v, float) else v for v in r) for r in df.astype(object).itertuples(index=False))  # noqa: E731 - all are whole numbers or text
    assert rows(got) == rows(want) and len(got)
