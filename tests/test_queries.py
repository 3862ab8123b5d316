"""Each registered query against its SQL on the smallest tables; those of removable plans are tested with them."""

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
CORE = [n for n, f in entry.queries().items() if f.__module__.startswith("citygrain.plans.")]


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for f in DATA.glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return db


def rows_of(frame):
    """Rows as sorted texts, columns by name, floats to six digits."""
    frame = frame[sorted(frame.columns)]
    text = lambda v: "" if v is None or (np.isscalar(v) and v != v) or v is pd.NA or v is pd.NaT else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(v) for v in row) for row in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, str(DATA)).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    if name in entry.oracle_sql():
        want = duck.execute(entry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
