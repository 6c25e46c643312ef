"""Errors of pair statistics, the running pair table and table lookup against NumPy."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyframe.operators import correlation, photometry
from skyframe.operators.lineage import scratch
from skyframe.operators.lookup import Grid, interpolated

BOX, EDGES = 100.0, [0.0, 8.0, 16.0, 24.0]


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame(np.vstack([rng.uniform(0, BOX, (150, 3)), rng.normal(50, 6, (150, 3)) % BOX]), columns=list("xyz")).assign(id=range(300), w=rng.uniform(-0.2, 2, 300), split=rng.integers(0, 4, 300))
    pdf.loc[:3, "x"] = [0.0, 50.0, 100.0, 50.0]  # on faces
    return pdf, spark.createDataFrame(pdf)


def counts(a, b, wa=None, wb=None, ia=None, ib=None):
    d = np.abs(a[:, None] - b[None])
    d = np.sqrt((np.minimum(d, BOX - d) ** 2).sum(-1))
    w = np.ones(d.shape) if wa is None else wa[:, None] * wb[None]
    w = np.where((np.arange(len(a)) if ia is None else ia)[:, None] == (np.arange(len(b)) if ib is None else ib)[None], 0, w)
    return np.array([w[(d > lo) & (d <= hi) | (d == 0) & (lo == 0)].sum() for lo, hi in zip(EDGES, EDGES[1:])])


SHELLS = np.array([4 / 3 * math.pi * (hi**3 - lo**3) for lo, hi in zip(EDGES, EDGES[1:])])


def covar(full, samples):
    d = samples - full
    return (len(samples) - 1) / len(samples) * d.T @ d / len(full)


def test_jackknife_is_leave_one_cube_out(cloud):
    pdf, df = cloud
    x = pdf[list("xyz")].to_numpy()
    full, samples, cov = correlation.jackknife(df, "id", ["x", "y", "z"], BOX, EDGES, 2)
    xi = lambda p: counts(p, p) / (SHELLS * len(p) ** 2 / BOX**3) - 1
    want = []
    for cube in itertools.product(range(2), repeat=3):
        low = np.array(cube) * 50.0
        want.append(xi(x[~((x > low) & (x <= low + 50)).all(1)]))
    got = samples.toPandas().pivot(index="replica", columns="bin", values="xi").to_numpy()
    assert np.allclose(got, want)
    c = cov.toPandas().pivot(index="bin_a", columns="bin_b", values="covar").to_numpy()
    assert np.allclose(c, covar(xi(x), np.array(want)))
    f = full.toPandas().sort_values("bin")
    assert np.allclose(f.xi, xi(x)) and np.allclose(f.xi_err, np.sqrt(np.diag(c))) and (f.dd == counts(x, x)).all()


def test_pair_table_is_refined_by_splits(spark, cloud):
    pdf, df = cloud
    x, w, split = pdf[list("xyz")].to_numpy(), np.maximum(pdf.w.to_numpy(), 0), pdf.split.to_numpy()
    table = correlation.PairTable(spark, scratch(spark, "pairs"), BOX, EDGES)
    ids = np.arange(300)
    dd = np.array([counts(x, x[split == k], w, w[split == k], ids, ids[split == k]) for k in range(4)])
    rr = np.array([SHELLS / BOX**3 * w.mean() ** 2 * 300 * (split == k).sum() for k in range(4)])
    for added, have in (([2], [2]), ([0, 1], [0, 1, 2]), ([1], [0, 1, 2]), ([3], [0, 1, 2, 3])):  # one of them again
        table.add(df, added, "id", ["x", "y", "z"], "split", "w")
        full, cov = table.combined()
        f = full.toPandas().sort_values("bin")
        d, r = dd[have], rr[have]
        want = d.sum(0) / r.sum(0) - 1
        assert np.allclose(f.xi, want) and (f.splits == len(have)).all()
        if len(have) > 1:
            c = covar(want, (d.sum(0) - d) / (r.sum(0) - r) - 1)
            assert np.allclose(cov.toPandas().pivot(index="bin_a", columns="bin_b", values="covar").to_numpy(), c) and np.allclose(f.xi_err, np.sqrt(np.diag(c)))
    with pytest.raises(ValueError):
        table.add(df.withColumn("w", F.lit(float("inf"))), [0], "id", ["x", "y", "z"], "split", "w")


# --- tables ---------------------------------------------------------------------------------------------------------
AXES = (np.array([0.0, 1, 3]), np.array([-1.0, 0, 2, 5]), np.array([2.0]), np.array([0.0, 1.0, 1.5, 9]))
VALUES = np.random.default_rng(0).normal(size=(3, 4, 1, 4))


def multilinear(axes, values, point):
    for a, x in zip(axes, point):
        x = min(max(x, a[0]), a[-1])
        i = min(max(int(np.searchsorted(a, x)) - 1, 0), max(len(a) - 2, 0))
        values = values[0] if len(a) == 1 else values[i] + (values[i + 1] - values[i]) * (x - a[i]) / (a[i + 1] - a[i])
    return values


@pytest.fixture(scope="module")
def grid_table(spark):
    rows = [(*map(float, p), float(v), "x") for p, v in zip(itertools.product(*AXES), VALUES.ravel())]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, v double, other string").repartition(3)


@pytest.fixture(scope="module")
def asked(spark):
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, p)) for i, p in enumerate(rng.uniform(-2, 10, (300, 4)))] + [(1000 + k, *map(float, p)) for k, p in enumerate(itertools.product(*AXES))]
    return spark.createDataFrame([*rows, (2000, None, 0.0, 0.0, 0.0), (2001, float("nan"), 0.0, 0.0, 0.0)], "id long, p double, q double, r double, s double")


@pytest.mark.parametrize("most", [1 << 22, 10])
def test_lookup_in_four_dimensions(grid_table, asked, most):
    """As one array and, with `most` below the number of nodes, by a join of cells."""
    out = interpolated(asked, grid_table, {"a": "p", "b": "q", "c": "r", "d": "s"}, "v", "found", most=most)
    got = out.collect()
    assert len(got) == asked.count() and out.columns == [*asked.columns, "found"]
    for r in got:
        if r.id >= 2000:
            assert r.found is None or math.isnan(r.found)
        else:
            assert r.found == pytest.approx(multilinear(AXES, VALUES, (r.p, r.q, r.r, r.s)), abs=1e-12)


def test_spline_meets_nodes_and_is_the_clamped_spline(spark, grid_table, asked):
    g = Grid.collected(grid_table, ["a", "b", "c", "d"], "v")
    assert np.allclose(g.at([n.ravel() for n in np.meshgrid(*AXES, indexing="ij")], 3), VALUES.ravel())
    y = VALUES[0, :, 0, :].ravel()[:7]
    n = len(y)
    m, d = np.diag(np.full(n, 4.0)) + np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1), np.zeros(n)
    m[0, 0] = m[-1, -1] = 2
    d[0], d[-1], d[1:-1] = 6 * (y[1] - y[0]), 6 * (y[-2] - y[-1]), 6 * (y[2:] - 2 * y[1:-1] + y[:-2])
    bend = np.linalg.solve(m, d)  # second derivatives of the spline that is flat at both ends
    x = np.random.default_rng(1).uniform(0, n - 1, 60)
    i = np.minimum(x.astype(int), n - 2)
    t = x - i
    want = bend[i] * (1 - t) ** 3 / 6 + bend[i + 1] * t**3 / 6 + (y[i] - bend[i] / 6) * (1 - t) + (y[i + 1] - bend[i + 1] / 6) * t
    assert np.allclose(Grid((np.arange(float(n)),), y).at([x], 3), want)
    out = interpolated(asked, grid_table, {"a": "p", "b": "q", "c": "r", "d": "s"}, "v", "found", order=3).where("id < 2000").toPandas()
    assert np.allclose(out.found, g.at([out[c].to_numpy() for c in "pqrs"], 3))


def test_lookup_needs_a_whole_grid(grid_table, asked):
    for bad in (grid_table.where("v < 1"), grid_table.union(grid_table), grid_table.limit(0)):
        with pytest.raises(ValueError):
            Grid.collected(bad, ["a", "b", "c", "d"], "v")
    with pytest.raises(ValueError):
        interpolated(asked, grid_table, {"a": "p", "b": "q", "c": "r", "d": "s"}, "v", "found", order=3, most=10)


def test_magnitudes_through_a_slit(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 60), "m": rng.uniform(15, 25, 60), **{a: rng.normal(0, 40, 60) for a in "xyz"}})
    pdf.loc[:2, "m"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("m", F.when(~F.isnan("m"), F.col("m")))
    got = photometry.band_magnitudes(df, "k", "m", {a: a for a in "xyz"}, 50.0, (80.0, 30.0), 12.0).toPandas().set_index(["k", "view"])

    def share(u, width):
        at = np.linspace(-width / 2, width / 2, 101) - u
        return np.exp(-0.5 * (at / 12.0) ** 2).sum() * width / 100 / (math.sqrt(2 * math.pi) * 12.0)

    for (k, view), (u, v) in [((k, w), tuple(o)) for k in range(3) for w, o in {"x": "yz", "y": "xz", "z": "xy"}.items()]:
        p = pdf[(pdf.k == k) & pdf.m.notna()]
        light = 10 ** (-0.4 * p.m)
        assert got.loc[(k, view)].circle == pytest.approx(-2.5 * np.log10(light[p[u] ** 2 + p[v] ** 2 <= 2500].sum()))
        near = (p[u].abs() <= 100) & (p[v].abs() <= 75)
        assert got.loc[(k, view)].slit == pytest.approx(-2.5 * np.log10(sum(s * share(a, 80.0) * share(b, 30.0) for s, a, b in zip(light[near], p[u][near], p[v][near]))))
