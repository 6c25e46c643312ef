"""Queries on neighbours of 120,000 objects at 8 places, most of them in reach of each other: ten thousand million pairs of rows."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.plans import roles
from skyframe.queries import load_all

load_all()
N = 120_000


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("crowd"))
    rows = spark.range(N).select(
        F.expr("id * 1000 + id % 4").alias("o_orderkey"), F.expr("id div 8 * 1000 + id div 4 % 2").alias("o_custkey"), F.expr("20000D + id * 7919 % 4800 * 100").alias("o_totalprice"), F.lit("1-URGENT").alias("o_orderpriority"))
    rows.write.parquet(f"{path}/orders.parquet")
    return path, roles.Tables(spark, path).subs.orderBy("sub_id").toPandas()


@pytest.fixture(autouse=True)
def in_time(spark):
    timer = threading.Timer(120, spark.sparkContext.cancelAllJobs)
    timer.start()
    yield
    timer.cancel()


def around(subs, i):
    """Distances of all objects from one, itself at infinity, and the masses."""
    gap = np.abs(subs[list("xyz")].to_numpy() - subs[list("xyz")].to_numpy()[i])
    d = np.sqrt((np.minimum(gap, 1000 - gap) ** 2).sum(1))
    d[i] = np.inf
    return d, subs.mass.to_numpy()


def result(spark, orders, name, i):
    path, subs = orders
    return roles.QUERIES[name](spark, path).where(F.col("center") == int(subs.sub_id[i])).toPandas()


@pytest.mark.parametrize("i", [5, 1002])
def test_a19(spark, orders, i):
    d, m = around(orders[1], i)
    near, got = m[d <= 120], result(spark, orders, "a19_neighbour_statistics", i).iloc[0]
    assert (got.n, got.lo, got.hi, got.mid) == (len(near), near.min(), near.max(), np.median(near)) and got.total == round(near.sum(), 2)


def test_a20(spark, orders):
    d, m = around(orders[1], 7)
    assert result(spark, orders, "a20_restricted_neighbours", 7).n[0] == ((d <= 120) & (m > 50000) & (m < 400000) & (m > m[7] / 2) & (m < m[7] * 2)).sum()


def test_a23(spark, orders):
    d, m = around(orders[1], 7)
    u = np.minimum(d / 120, 1)
    w = np.where(u < 0.5, 1 - 6 * u * u + 6 * u**3, 2 * (1 - u) ** 3)
    assert abs(result(spark, orders, "a23_kernel_mean", 7)["mean"][0] - (m * w).sum() / w.sum()) < 1e-5


def test_a58(spark, orders):
    path, subs = orders
    got = roles.QUERIES["a58_isolation"](spark, path).where(F.col("sub_id") == int(subs.sub_id[7])).first()
    m30 = (subs.mass * (0.1 + subs.sub_id % 5 / 10.0)).to_numpy()
    d, _ = around(subs, 7)
    top = m30[(d > 0) & (d <= 120)].max()
    assert m30[7] < 30000 and got["mstar30_max"] == -1 or got["mstar30_max"] == int(top <= m30[7])


def per_place(subs):
    """(rows of the center's place, bin of 20, rows there) for every two of the 8 places; a row is not its own neighbour."""
    where = subs.groupby(list("xyz")).agg(n=("mass", "size"), red=("mass", lambda v: (v > 250000).sum()), total=("mass", "sum")).reset_index()
    x = where[list("xyz")].to_numpy()
    gap = np.abs(x[:, None] - x[None])
    return where, np.sqrt((np.minimum(gap, 1000 - gap) ** 2).sum(-1))


@pytest.mark.parametrize("name", ["a59_conformity", "a59b_conformity_errors"])
def test_conformity(spark, orders, name):
    path, subs = orders
    where, d = per_place(subs)
    got = {r["bin"]: r["stacked"] for r in roles.QUERIES[name](spark, path).collect()}
    n, red = where.n.to_numpy(), where.red.to_numpy()
    for b in range(3):
        k = (d >= b * 40) & (d < b * 40 + 40)
        own = np.eye(len(n), dtype=bool) & k
        pairs, hits = (n[:, None] * n[None] * k).sum() - n[own.any(1)].sum(), (n[:, None] * red[None] * k).sum() - red[own.any(1)].sum()
        assert (b in got) == (pairs > 0) and (not pairs or got[b] == round(hits / pairs, 8))


def test_a21(spark, orders):
    d, m = around(orders[1], 7)
    got = result(spark, orders, "a21_neighbour_profiles", 7)
    assert {r.bin: (r.n, r.mass) for r in got.itertuples()} == {b: (k.sum(), round(m[k].sum(), 2)) for b in range(6) if (k := (d >= b * 20) & (d < b * 20 + 20)).any()}


def test_a22(spark, orders):
    d, m = around(orders[1], 7)
    got = result(spark, orders, "a22_reductions_in_bins", 7)
    assert {r.bin: (r.hi, r.lo, r.total) for r in got.itertuples()} == {b: (m[k].max(), m[k].min(), round(m[k].sum(), 2)) for b in range(6) if (k := (d > b * 20) & (d <= b * 20 + 20)).any()}


def test_a25(spark, orders):
    d, m = around(orders[1], 7)
    h, near = orders[1].halo_id.to_numpy(), d <= 120
    want = {"all": near, "self": near & (h == h[7]), "diffuse": near & (h != h[7]) & (h % 10 == 0), "other": near & (h != h[7]) & (h % 10 != 0)}
    got = result(spark, orders, "a25_profile_terms", 7)
    assert {r.term: (r.n, r.mass) for r in got.itertuples()} == {k: (v.sum(), round(m[v].sum(), 2)) for k, v in want.items() if v.any()}


def test_a104(spark, orders):
    path, subs = orders
    got = {r["bin"]: r["clumps"] for r in roles.QUERIES["a104_clump_profiles"](spark, path).collect()}
    where, d = per_place(subs)
    centers = subs[subs.halo_id % 5 == 0].groupby(list("xyz")).size().reindex(where.set_index(list("xyz")).index, fill_value=0).to_numpy()
    assert got == {b: centers[k.any(1)].sum() for b in range(6) if (k := (d >= b * 20) & (d < b * 20 + 20)).any() and centers[k.any(1)].sum()}


def test_a83(spark, orders):
    """18 samples around each object, at 144 places at most; the 8 nearest objects of each are at one place."""
    path, subs = orders
    out = roles.QUERIES["a83_direction_samples"](spark, path)
    ask = int(subs.sub_id[7]) * 1000 + 60 * 4 + 1
    n, distance = out.agg(F.count(F.lit(1)), F.max(F.when(F.col("sample") == ask, F.col("distance")))).first()
    gap = np.abs((subs[list("xyz")].to_numpy()[7] + [60, 0, 0]) % 1000 - subs[list("xyz")].to_numpy())
    assert n == 18 * N and abs(distance - np.sqrt((np.minimum(gap, 1000 - gap) ** 2).sum(1)).min()) < 1e-5
