"""Registered queries against DuckDB over the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__

DATA = Path("/root/testdata/sf0.001")
NAMES = sorted(n for n, (_, sql) in __spark_entry__._OWN.items() if sql)


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return None
    if hasattr(x, "item"):
        x = x.item()
    return int(x) if isinstance(x, float) and x == int(x) else x


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return Counter(repr(tuple(plain(x) for x in r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    if not DATA.is_dir():
        pytest.skip("no tables here")
    con = duckdb.connect()
    for p in DATA.iterdir():
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, str(DATA)).toPandas()
    want = duck.execute(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want) and len(got)


def test_entry(spark, duck):
    assert __spark_entry__.entry(spark).count() > 0
