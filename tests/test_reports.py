"""Registered reports against their SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from siftlode.plans import reports
from siftlode.plans.queries import ORACLES, QUERIES

TABLES = "/root/testdata/sf0.001"
OWN = [n for n in QUERIES if QUERIES[n].__module__ == reports.__name__]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(TABLES).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    return None if x is None or isinstance(x, float) and math.isnan(x) else round(float(x), 5) if isinstance(x, float) or type(x).__name__ == "Decimal" else x


@pytest.mark.parametrize("name", OWN)
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, TABLES)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = lambda found: sorted((tuple(map(plain, r)) for r in found), key=repr)
    expected = rows(want.fetchall())
    assert expected and rows(tuple(r[n] for n in names) for r in got.collect()) == expected
