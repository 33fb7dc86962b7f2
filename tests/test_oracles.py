"""Every registered query of the library, at a small scale, against its SQL; those without SQL must give rows."""

from __future__ import annotations

import datetime
import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from barwright.plans import market, registry, research, samples, supervision  # noqa: F401

NAMES = sorted(registry.QUERIES)


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _text(v) -> str:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return "~"
    if isinstance(v, (pd.Timestamp, datetime.datetime)):
        return str(v)[:10]
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating)):
        return f"{float(v):.6g}"
    return str(v.tolist() if isinstance(v, np.ndarray) else v)


def _rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(map(_text, row)) for row in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, db, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    if name not in registry.ORACLES:
        assert len(got.columns) and len(got)
        return
    want = db.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)
