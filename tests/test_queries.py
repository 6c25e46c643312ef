"""Every query with SQL agrees with DuckDB on the smallest tables; every other one at least runs."""

import math
import os

import duckdb
import pytest

from skyframe.plans import roles
from skyframe.queries import load_all

load_all()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "none"
    if isinstance(v, bool | str):
        return str(v)
    try:
        return repr(float(v))
    except TypeError:
        return str(v)


@pytest.mark.parametrize("name", sorted(roles.QUERIES))
def test_query(spark, duck, name):
    df = roles.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in roles.ORACLES:
        assert got
        return
    res = duck.execute(roles.ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall())
