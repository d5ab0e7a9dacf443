"""Every query that has SQL gives the same rows in DuckDB, on the smallest data."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

from .conftest import DATA

SF = f"{DATA}/sf0.001"


def canon(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, dict):
        return tuple((k, canon(x)) for k, x in sorted(v.items()))
    if hasattr(v, "asDict"):
        return canon(v.asDict())
    if isinstance(v, list | tuple):
        return tuple(canon(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(repr(tuple(canon(r[c]) for c in cols)) for r in df.collect())
    res = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = Counter(repr(tuple(canon(r[names.index(c)]) for c in cols)) for r in res.fetchall())
    assert got == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
