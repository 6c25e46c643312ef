"""Image statistics, kernel-weighted sizes and matched realisations against NumPy."""

import numpy as np
import pandas as pd
import pytest

from skyframe.operators import images, matching, spatial


def moment20(x, y, v):
    c = (x * v).sum() / v.sum(), (y * v).sum() / v.sum()
    s = np.sort(v)
    threshold = s[np.searchsorted(np.cumsum(s) >= 0.8 * s.sum(), True)]
    of = lambda w: (x * x * w).sum() - c[0] * (x * w).sum() + (y * y * w).sum() - c[1] * (y * w).sum()
    with np.errstate(invalid="ignore"):
        return np.log10(of(np.where(v >= threshold, v, 0)) / of(v)), threshold


def test_m20_and_threshold(spark):
    rng, parts = np.random.default_rng(1), []
    for k in range(4):
        x, y = (a.ravel() for a in np.meshgrid(np.arange(20), np.arange(15)))
        v = np.exp(-((x - 9) ** 2 + (y - 5 - k) ** 2) / (8 + 10 * k)) + rng.uniform(0, 0.05, x.size)
        parts.append(pd.DataFrame({"k": k, "x": x, "y": y, "v": np.round(v, 1) if k == 3 else v}))  # many equal values
    pdf = pd.concat(parts)
    df = spark.createDataFrame(pdf)
    for levels in (2, 1024):
        got = images.brightest_share(df, "k", "v", 0.8, levels).toPandas().set_index("k").threshold
        assert all(got[k] == pytest.approx(moment20(p.x, p.y, p.v.to_numpy())[1]) for k, p in pdf.groupby("k"))
    got = images.m20(df, "k", "x", "y", "v").toPandas().set_index("k").m20
    want = {k: moment20(p.x, p.y, p.v.to_numpy())[0] for k, p in pdf.groupby("k")}
    assert all(got[k] == pytest.approx(want[k], nan_ok=True) for k in want) and np.isfinite(want[2])  # no number: a moment not over 0
    dark = spark.createDataFrame([(1, 0, 0, 0.0), (1, 1, 0, 0.0), (2, 3, 3, 1.0)], "k int, x int, y int, v double")
    assert [r.m20 for r in images.m20(dark, "k", "x", "y", "v").collect()] == [None, None]


def test_bounding_ellipses(spark):
    rng, rows = np.random.default_rng(2), []
    for k, angle in enumerate((0.0, 30.0, 120.0)):
        x, y = (a.ravel() - 30.0 for a in np.meshgrid(np.arange(61), np.arange(61)))
        c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
        inside = ((x * c + y * s) / 24) ** 2 + ((-x * s + y * c) / 10) ** 2 <= 1
        rows += [(k, float(a), float(b), 1.0 if i else float(rng.uniform(0, 0.5))) for a, b, i in zip(x, y, inside)]
    rows += [(7, 0.0, 0.0, 1.0), (7, 1.0, 1.0, 1.0), (7, 2.0, 2.0, 1.0), (8, 0.0, 0.0, 1.0)]
    got = images.bounding_ellipses(spark.createDataFrame(rows, "k int, x double, y double, v double"), "k", "x", "y", "v", 0.9, close=1e-4).toPandas().set_index("k")
    for k, angle in enumerate((0.0, 30.0, 120.0)):
        r = got.loc[k]
        assert r.major == pytest.approx(24, rel=0.03) and r.minor == pytest.approx(10, rel=0.05) and abs((r.angle - angle + 90) % 180 - 90) < 2
        p = np.array([(x, y) for g, x, y, v in rows if g == k and v >= 0.9]) - [r.cx, r.cy]
        c, s = np.cos(np.radians(r.angle)), np.sin(np.radians(r.angle))
        assert ((((p @ [c, s]) / r.major) ** 2 + ((p @ [-s, c]) / r.minor) ** 2).max()) < 1.05  # bounds every point
    assert got.loc[[7, 8]].isna().all().all()


def test_weighted_size(spark):
    rng, box = np.random.default_rng(3), 100.0
    x = np.vstack([rng.uniform(0, box, (150, 3)), rng.normal(50, 0.5, (60, 3))])  # half of a list of 2 N is a tight clump
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("xyz")).assign(id=range(len(x))))
    got = spatial.adaptive_size(df, df, "id", "id", ["x", "y", "z"], box, 20.0, 10.0).toPandas().set_index("center")["size"]
    d = np.abs(x[:, None] - x[None])
    d = np.sqrt((np.minimum(d, box - d) ** 2).sum(-1))
    assert len(got) == len(x)
    for i, h in got.items():
        u = d[i] / h
        w = np.where(u < 0.5, 1 - 6 * u**2 + 6 * u**3, np.where(u < 1, 2 * (1 - u) ** 3, 0)).sum() * 32 / 3
        assert w == pytest.approx(20, abs=1e-6)
    few = spatial.adaptive_size(df.limit(1), df.limit(1), "id", "id", ["x", "y", "z"], box, 20.0).collect()
    assert [r["size"] for r in few] == [None]


def test_realisations_fall_back(spark):
    targets = spark.createDataFrame([(1, r, "a", v) for r, v in enumerate([5.0, 50.0, 7.0, 60.0])] + [(2, 0, "a", 99.0), (2, 1, "a", 6.0), (3, 0, "z", 1.0)], "t int, r int, kind string, v double")
    items = spark.createDataFrame([(10, "a", 4.0), (11, "a", 8.0), (12, "a", float("nan")), (13, "b", 5.0)], "i int, kind string, v double")
    from pyspark.sql import functions as F

    got = matching.matched_realisations(targets, items, ["kind"], lambda a, b: F.col("t.v") < 40, {"v": 1.0}, "t", "r", "i").collect()
    assert {(r.t, r.r): (r.i, r.distance) for r in got} == {(1, 0): (10, 1.0), (1, 1): (10, None), (1, 2): (11, 1.0), (1, 3): (11, None), (2, 0): (None, None), (2, 1): (10, 2.0), (3, 0): (None, None)}
