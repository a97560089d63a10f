"""Every query with an oracle against DuckDB on the smallest tables."""

from pathlib import Path

import numpy as np
import pandas as pd
import pytest

import __spark_entry__

duckdb = pytest.importorskip("duckdb")
DATA = Path("/root/testdata/sf0.001")
QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()


def cell(x):
    if isinstance(x, list | tuple | np.ndarray):
        return [cell(y) for y in x]
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, bool | np.bool_):
        return bool(x)
    return float(x) if isinstance(x, int | float | np.number) else x


def rows(frame):
    return sorted(str([cell(v) for v in r]) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, str(DATA)).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {n for n in QUERIES if n.startswith("op") or n == "pipeline"}))
def test_query_without_oracle_runs(spark, name):
    QUERIES[name](spark, str(DATA)).collect()
