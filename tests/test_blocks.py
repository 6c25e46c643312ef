"""Reductions over neighbours, by places and in blocks: against brute force, and on rows too many for pairs of rows."""

import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyframe.operators import blocks, correlation, spatial

XYZ, EDGES = ["x", "y", "z"], [0.0, 8.0, 16.0, 24.0]


@pytest.fixture
def in_time(spark):
    """Cancels Spark's jobs after two minutes; before, rows at few places met in pairs of rows for hours."""
    timer = threading.Timer(120, spark.sparkContext.cancelAllJobs)
    timer.start()
    yield
    timer.cancel()


@pytest.fixture(scope="module")
def crowd(spark):
    """200,000 rows at 8 places, so there are 40 thousand million pairs of rows."""
    rows = spark.range(200_000).withColumns({"x": F.expr("id % 2 * 10.0D"), "y": F.expr("id div 2 % 2 * 10.0D"), "z": F.expr("id div 4 % 2 * 10.0D"), "s": F.expr("cast(id % 5 as int)"), "w": F.lit(2.0)})
    return rows


def test_pairs_of_crowded_places(spark, crowd, in_time):
    got = {r["bin"]: r["dd"] for r in spatial.pair_counts(crowd, crowd, "id", "id", XYZ, 100.0, EDGES, auto=True).collect()}
    n = 25_000
    assert got == {0: 8.0 * n * (n - 1), 1: 8.0 * 6 * n * n, 2: 8.0 * n * n}


def test_tagged_pairs_of_crowded_places(spark, crowd, in_time):
    got = {(r["bin"], r["tag_a"], r["tag_b"]): r["dd"] for r in spatial.pair_counts(crowd, crowd, "id", "id", XYZ, 100.0, EDGES, auto=True, tags=("s", "s")).collect()}
    n = 5_000
    assert got[0, 1, 1] == 8.0 * n * (n - 1) and got[0, 1, 2] == 8.0 * n * n and got[2, 4, 0] == 8.0 * n * n and len(got) == 75


def test_weighted_pairs_of_crowded_places(spark, crowd, in_time):
    got = {(r["bin"], r["tag_a"], r["tag_b"]): r["dd"] for r in spatial.pair_counts(crowd, crowd, "id", "id", XYZ, 100.0, EDGES, auto=True, weight="w", tags=("s", "s")).collect()}
    assert got[0, 1, 1] == 4 * 8.0 * 5_000 * 4_999 and got[1, 3, 1] == 4 * 48.0 * 5_000**2


def test_jackknife_of_crowded_places(spark, crowd, in_time):
    full, _, _ = correlation.jackknife(crowd, "id", XYZ, 100.0, EDGES, 2)
    assert {r["bin"]: r["dd"] for r in full.collect()}[2] == 8.0 * 25_000**2


def test_pair_table_of_crowded_places(spark, crowd, in_time, tmp_path):
    """In steps, as a running table, and at once."""
    once, steps = (correlation.PairTable(spark, str(tmp_path / k), 100.0, EDGES) for k in "ab")
    once.add(crowd, [0, 1, 2, 3, 4], "id", XYZ, "s", "w")
    for splits in ([0, 1], [2, 3, 4]):
        steps.add(crowd, splits, "id", XYZ, "s", "w")
    a, b = (sorted(map(tuple, t.combined()[0].select("bin", "xi").collect())) for t in (once, steps))
    assert a == b and len(a) == 3


@pytest.fixture(scope="module")
def cloud(spark):
    """Rows near faces and edges, 60 of them at 6 places, some without a value."""
    rng = np.random.default_rng(3)
    pos = np.vstack([rng.uniform(0, 100, (240, 3)), np.repeat(rng.integers(0, 100, (6, 3)), 10, axis=0)]) - [100, 0, 0] * (rng.uniform(size=(300, 1)) < 0.2)
    pdf = pd.DataFrame(pos, columns=XYZ).assign(id=range(300), v=np.round(rng.uniform(1, 9, 300), 1), s=rng.integers(0, 3, 300))
    gap = np.abs(pos[:, None] % 100 - pos[None] % 100)
    d = np.sqrt((np.minimum(gap, 100 - gap) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    return pdf, spark.createDataFrame(pdf), d


@pytest.mark.parametrize("scale, limits", [(1.0, (20_000, 400_000)), (1.0, (3, 7)), (2.0, (20_000, 400_000))])
def test_around_is_brute_force(spark, cloud, monkeypatch, scale, limits):
    """Also with cells cut into small blocks, and with a radius over a third of the box."""
    pdf, df, d = cloud
    edges = [e * scale for e in EDGES]
    run = blocks.reduce_within
    monkeypatch.setattr(blocks, "reduce_within", lambda *a, **k: run(*a, **{**k, "crowd": limits}))
    out = blocks.around(df, XYZ, 100.0, edges, {"v": F.col("v")}, tops={"top": F.col("v")}, lows={"low": F.col("v")}, tag=F.col("s"))
    rows = blocks.placed(df, XYZ, 100.0).join(out.withColumnRenamed("v", "v_"), XYZ).collect()
    v, s = pdf.v.to_numpy(), pdf.s.to_numpy()
    got = {(r["id"], r["bin"], r["tag"]): (r["n"] + r["n0"] - (r["bin"] == 0 and r["tag"] == s[r["id"]]), r["v_"] + r["v0"] - (v[r["id"]] if r["bin"] == 0 and r["tag"] == s[r["id"]] else 0), r["top"], r["low"]) for r in rows}
    for i in range(300):
        for b, (lo, hi) in enumerate(zip(edges, edges[1:])):
            for t in range(3):
                near, apart = (d[i] >= lo) & (d[i] < hi) & (s == t), (d[i] >= max(lo, 1e-9)) & (d[i] < hi) & (s == t)
                n, total, top, low = got.get((i, b, t), (0, 0, None, None))
                assert n == near.sum() and abs(total - v[near].sum()) < 1e-9
                assert (top, low) == ((v[apart].max(), v[apart].min()) if apart.any() else (None, None))


@pytest.mark.parametrize("size", ["plain", "weighted"])
def test_first_radius_suits_the_density(spark, monkeypatch, size):
    """It held 2,000 of 8,000 points for 8 neighbours before."""
    rng = np.random.default_rng(5)
    pos = rng.uniform(0, 100, (8000, 3))
    df = spark.createDataFrame(pd.DataFrame(pos, columns=XYZ).assign(id=range(8000)))
    seen, join = [], spatial.radius_join
    monkeypatch.setattr(spatial, "radius_join", lambda *a, **k: seen.append(a[6]) or join(*a, **k))
    few = df.where("id % 100 = 0")
    if size == "plain":
        got = spatial.nearest(few, df, "id", "id", XYZ, 100.0, 8, 40.0, skip_self=False).groupBy("center").agg(F.max("distance").alias("d")).toPandas().set_index("center").d
        d = np.abs(pos[got.index][:, None] - pos[None])
        d = np.sqrt((np.minimum(d, 100 - d) ** 2).sum(-1))
        assert np.allclose(got, np.sort(d, 1)[:, 7]) and len(got) == 80
    else:
        assert spatial.adaptive_size(few, df, "id", "id", XYZ, 100.0, 8.0, 40.0).where("size > 0").count() == 80
    assert seen[0] < 12


def test_rays_at_one_place_are_one(spark, monkeypatch):
    """All 200 of them had candidates of their own before."""
    from skyframe.operators import sightlines

    seen, join = [], spatial.radius_join
    monkeypatch.setattr(spatial, "radius_join", lambda c, *a, **k: seen.append(c.count()) or join(c, *a, **k))
    cells = spark.createDataFrame(pd.DataFrame(np.random.default_rng(2).uniform(0, 100, (300, 3)), columns=XYZ).assign(cell=range(300)))
    lines = spark.range(200).select(F.col("id").alias("ray"), F.expr("id % 2 * 30D").alias("x"), F.lit(40.0).alias("y"))
    got = sightlines.rays_through_cells(lines, cells, "ray", "cell", ["x", "y"], "z", 100.0, 30.0).groupBy("ray").agg(F.sum("dl").alias("dl"), F.count(F.lit(1)).alias("n")).toPandas()
    assert seen[0] == 2 and len(got) == 200 and np.allclose(got.dl, 100) and got.groupby(got.ray % 2).n.nunique().max() == 1
