"""Every query that has SQL, against DuckDB on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from lectern.plans import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def plain(value):
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(plain(v) for v in value)
    if value is None or value is pd.NA or value is pd.NaT or value != value:
        return None
    return value.item() if isinstance(value, np.generic) else str(value) if isinstance(value, pd.Timestamp) else round(value, 6) if isinstance(value, float) else value


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')").fetchall()
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, str(DATA)).toPandas()) == rows(duck.sql(catalog.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "id"
    assert set(entry.oracle_sql()) <= set(entry.queries())
