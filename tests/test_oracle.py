"""Every query with SQL against DuckDB on the same tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from revlytics import catalog


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def table_of(frame: pd.DataFrame) -> list:
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), duck.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert table_of(got) == table_of(want)
