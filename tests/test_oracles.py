"""Every query with an oracle against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry


def _plain(v):
    if isinstance(v, int | float | np.number) and not isinstance(v, bool):
        return f"{float(v) + 0.0:.6f}"
    return str(v)


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(_plain(None if pd.isna(v) else v) for v in row) for row in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, sf_dir).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_entry(spark, sf_dir):
    assert entry.entry(spark).columns
