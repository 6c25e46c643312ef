"""Fits of large objects in rounds, reductions in parts, rays through cells: the same as in one group, and as NumPy."""

import numpy as np
import pandas as pd
import pytest

from skyframe.operators import maps, reduce, shapes, sightlines
from skyframe.plans import catalogs


@pytest.fixture(scope="module")
def objects(spark):
    """Four objects, one with most of the rows; object 3 has too few rows and object 4 lies in a plane."""
    rng, parts = np.random.default_rng(21), []
    for k, (n, q, s) in enumerate([(3000, 0.8, 0.5), (500, 0.6, 0.55), (400, 1.0, 0.9), (12, 0.7, 0.6), (200, 0.7, 0.0)]):
        turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        x = rng.normal(size=(n, 3)) * [1, q, s] @ turn.T
        parts.append(pd.DataFrame(x * 10, columns=list("xyz")).assign(k=k, m=rng.uniform(0.5, 2, n)))
    pdf = pd.concat(parts, ignore_index=True)
    return pdf, spark.createDataFrame(pdf)


def brute_ellipsoid(x, m, inner, outer, least=20, close=1e-2):
    q = s = 1.0
    frame = x.copy()
    for _ in range(100):
        d2 = frame[:, 0] ** 2 + (frame[:, 1] / q) ** 2 + (frame[:, 2] / s) ** 2
        w = (d2 > inner**2) & (d2 <= outer**2)
        if w.sum() < least:
            break
        value, vector = np.linalg.eigh((frame[w] * m[w, None]).T @ frame[w] / m[w].sum())
        if value[0] <= 1e-12 * value[2]:
            break
        frame = frame @ vector[:, ::-1]
        new = np.sqrt(value[1] / value[2]), np.sqrt(value[0] / value[2])
        moved = max(abs(new[0] - q) / q, abs(new[1] - s) / s)
        q, s = new
        if moved <= close:
            break
    return (q, s) if (q, s) != (1.0, 1.0) else (None, None)


def test_ellipsoids_in_rounds(objects):
    pdf, df = objects
    for small in (10**6, 150, 0):
        got = {r.k: r for r in shapes.ellipsoids(df, "k", ["x", "y", "z"], "m", 4.0, 20.0, small=small).collect()}
        assert sorted(got) == [0, 1, 2, 3, 4]
        for k, one in pdf.groupby("k"):
            q, s = brute_ellipsoid(one[["x", "y", "z"]].to_numpy(), one.m.to_numpy(), 4.0, 20.0)
            assert got[k].rows == len(one)
            assert (got[k].q, got[k].s) == (None, None) if q is None else (got[k].q, got[k].s) == pytest.approx((q, s), rel=1e-9)


def test_shrinking_centers_in_rounds(spark):
    rng = np.random.default_rng(4)
    parts = [np.vstack([rng.normal(c, 0.4, (60, 3)) % 10, rng.uniform(0, 10, (20, 3))]) for c in (0.1, 6.0)]
    parts.append(rng.integers(0, 3, (70, 3)).astype(float))  # many rows at one place, many equally far
    parts.append(np.full((25, 3), 2.5))
    pdf = pd.concat([pd.DataFrame(x, columns=list("xyz")).assign(k=k) for k, x in enumerate(parts)])
    df = spark.createDataFrame(pdf)
    how = {"box": 10.0, "stop": 0.93}
    one = shapes.shrinking_centers(df, "k", ["x", "y", "z"], **how).toPandas().set_index("k").sort_index()
    many = shapes.shrinking_centers(df, "k", ["x", "y", "z"], **how, small=0).toPandas().set_index("k").sort_index()
    assert np.allclose(one[["x", "y", "z"]], many[["x", "y", "z"]], atol=1e-9) and len(one) == 4


def test_kth_smallest_is_exact(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 900), "v": np.round(rng.lognormal(0, 4, 900), 1), "w": rng.integers(1, 5, 900)})
    wanted = [(0, 1), (1, 200), (2, int(pdf[pdf.k == 2].w.sum()))]
    df = spark.createDataFrame(pdf.rename(columns={"k": "o"}))
    got = {r.o: r for r in shapes.kth_smallest(df, "o", "v", "w", spark.createDataFrame(wanted, "o long, k long"), bins=4).collect()}
    for o, k in wanted:
        flat = np.sort(np.repeat(pdf[pdf.k == o].v, pdf[pdf.k == o].w))
        assert got[o].cut == flat[k - 1] and got[o].below == (flat < flat[k - 1]).sum()


def test_reductions_in_parts(spark):
    catalogs.reducer("product_of_test", finish=lambda parts: np.exp(parts[:, 0].sum()) * parts[:, 1].sum())(lambda pdf: [np.log(pdf["v"]).sum(), len(pdf)])
    catalogs.reducer("median_of_test")(lambda pdf: pdf["v"].median())
    pdf = pd.DataFrame({"o": [1] * 60 + [2] * 3, "v": np.linspace(0.5, 1.5, 63)})
    df = spark.createDataFrame(pdf)
    want = pdf.groupby("o").v.agg(lambda v: v.prod() * len(v))
    for most in (7, 1000):
        got = catalogs.reduce_custom(df, "o", "product_of_test", most=most).toPandas().set_index("o").product_of_test
        assert np.allclose(got.sort_index(), want)
    assert catalogs.reduce_custom(df, "o", "median_of_test").toPandas().set_index("o").median_of_test[1] == pytest.approx(pdf.v[:60].median())
    with pytest.raises(ValueError, match="register it in parts"):
        catalogs.reduce_custom(df, "o", "median_of_test", most=7)


@pytest.mark.parametrize("n, radius, most", [(40, 2.0, 100_000), (1, 5.0, 100_000), (300, 8.0, 40)])
def test_rays_through_sparse_periodic_cells(spark, n, radius, most):
    """Candidates within the first radius are far too few on the sparse tables; on the dense one rays are cut into slices."""
    rng, box = np.random.default_rng(n), 100.0
    cells = pd.DataFrame(rng.uniform(0, box, (n, 3)), columns=list("xyz")).assign(cell=range(n))
    lines = pd.DataFrame(rng.uniform(0, box, (12, 2)), columns=list("xy")).assign(ray=range(12))
    got = sightlines.rays_through_cells(spark.createDataFrame(lines), spark.createDataFrame(cells), "ray", "cell", ["x", "y"], "z", box, radius, most).toPandas().sort_values(["ray", "seq"])
    assert np.allclose(got.groupby("ray").dl.sum().reindex(range(12)), box)
    z = np.linspace(0.013, box - 0.013, 700)
    for r in lines.itertuples():
        one = got[got.ray == r.ray]
        assert (one.seq.to_numpy() == np.arange(len(one))).all() and (one.cell.to_numpy()[1:] != one.cell.to_numpy()[:-1]).all()
        gap = np.abs(cells[["x", "y"]].to_numpy() - [r.x, r.y])
        d2 = (np.minimum(gap, box - gap) ** 2).sum(1)
        dz = np.abs(z[:, None] - cells.z.to_numpy()[None])
        total = d2[None] + np.minimum(dz, box - dz) ** 2
        found = one.cell.to_numpy()[np.searchsorted(np.cumsum(one.dl.to_numpy())[:-1], z)]
        assert np.allclose(total[np.arange(len(z)), found], total.min(1), atol=1e-6)


@pytest.mark.parametrize("dims", [2, 3])
def test_level_grid(spark, dims):
    rng, box, finest = np.random.default_rng(dims), 64.0, 16
    names = list("xyz")[:dims]
    pdf = pd.DataFrame(rng.uniform(0, box, (60, dims)), columns=names).assign(h=rng.choice([0.5, 3.0, 9.0, 20.0, 40.0], 60), m=rng.uniform(1, 2, 60))
    grid = maps.level_grid(spark.createDataFrame(pdf), names, "h", "m", box, finest, 3)
    want = {}
    for r in pdf.to_dict("records"):
        level = int(np.clip(np.ceil(np.log2(r["h"] / 8.0)), 0, 2))
        n, p = finest >> level, 4.0 * 2**level
        k = int(np.ceil(r["h"] / p))
        at = {}
        for step in np.ndindex(*[2 * k + 1] * dims):
            cell = [int(r[d] // p) + s - k for d, s in zip(names, step)]
            u = np.sqrt(sum(((c + 0.5) * p - r[d]) ** 2 for c, d in zip(cell, names))) / r["h"]
            w = 1 - 6 * u * u + 6 * u**3 if u < 0.5 else 2 * (1 - u) ** 3 if u < 1 else 0.0
            if w:
                at[tuple(c % n for c in cell)] = at.get(tuple(c % n for c in cell), 0) + w
        at = at or {tuple(int(r[d] // p) for d in names): 1.0}
        for c, w in at.items():
            want[(level, *c)] = want.get((level, *c), 0) + r["m"] * w / sum(at.values())
    got = {tuple(r)[:-1]: r.value for r in grid.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    fine = np.zeros((finest,) * dims)
    for (level, *c), v in want.items():
        fine[tuple(slice(i << level, (i + 1) << level) for i in c)] += v / 2 ** (level * dims)
    out = maps.refined(grid, [f"i{d}" for d in names]).collect()
    assert sum(r.value for r in out) == pytest.approx(pdf.m.sum())
    assert all(r.value == pytest.approx(fine[tuple(r)[:-1]]) for r in out) and len(out) == (fine > 0).sum()


def test_radii_and_order_of_large_objects(spark):
    """Objects cut into steps give what one window gives."""
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 500), "r": np.round(rng.exponential(5, 500), 1), "id": range(500), "w": rng.integers(1, 9, 500) * 0.5})
    df = spark.createDataFrame(pdf)
    for small in (10**6, 20):
        got = reduce.enclosing_radii(df, "k", "r", "w", {"half": 0.5, "most": 0.9}, ["id"], small).toPandas().set_index("k")
        nth = reduce.ordered_value(df, "k", "r", ["id"], 16, "r", small).toPandas().set_index("k").r
        over = reduce.overdensity(df, "k", "r", "w", ["id"], [1, 50], 1e-3, small).toPandas().set_index("k")
        for k, one in pdf.groupby("k"):
            one = one.sort_values(["r", "id"])
            c = one.w.cumsum().to_numpy()
            r = one.r.to_numpy()
            assert nth[k] == r[16]
            for n, f in (("half", 0.5), ("most", 0.9)):
                i = int(np.searchsorted(c, f * c[-1]))
                pr, pc = (r[i - 1], c[i - 1]) if i else (0.0, 0.0)
                assert got.loc[k, n] == pytest.approx(pr + (f * c[-1] - pc) / (c[i] - pc) * (r[i] - pr))
            inside = one[one.r > 0]
            rho = inside.w.cumsum() / (4 / 3 * np.pi * inside.r**3)
            for d in (1, 50):
                assert over.loc[k, f"r{d}"] == pytest.approx(inside.r[rho > d * 1e-3].max())


@pytest.mark.parametrize("n", [6, 9])
def test_power_spectra(spark, n):
    rng, box = np.random.default_rng(n), 50.0
    grids = {k: np.where(rng.random((n, n, n)) < 0.3, rng.normal(size=(n, n, n)), 0.0) for k in ("a", "b")}
    rows = [(k, int(x), int(y), int(z), float(v / 2)) for k, g in grids.items() for (x, y, z), v in np.ndenumerate(g) if v for _ in range(2)]  # cells in two parts
    got = shapes.power_spectra(spark.createDataFrame(rows, "k string, ix int, iy int, iz int, value double"), "k", n, box).toPandas()
    f = np.fft.fftfreq(n, 1 / n)
    shell = np.rint(np.sqrt(f[:, None, None] ** 2 + f[None, :, None] ** 2 + f[None, None, :] ** 2)).astype(int)
    assert len(got) == 2 * (n // 2 - 1)
    for r in got.itertuples():
        power = np.abs(np.fft.fftn(grids[r.k]) / n**3) ** 2
        assert r.power == pytest.approx(power[shell == r.shell].mean() * 4 * np.pi * (r.shell * 2 * np.pi / box) ** 2)


def test_principal_axes_of_tensors(spark):
    """Largest moment first, its axis with z not negative; the moments are those of the rows."""
    rng = np.random.default_rng(13)
    pdf = pd.DataFrame(rng.normal(size=(90, 3)) * [3, 2, 1], columns=list("xyz")).assign(k=np.arange(90) % 3, m=rng.uniform(1, 2, 90))
    got = shapes.principal_axes(reduce.inertia(spark.createDataFrame(pdf), "k", ["x", "y", "z"], "m"), "k").toPandas().set_index("k")
    for k, one in pdf.groupby("k"):
        x, m = one[["x", "y", "z"]].to_numpy(), one.m.to_numpy()
        tensor = np.eye(3) * (m * (x**2).sum(1)).sum() - (x * m[:, None]).T @ x
        value, vector = np.linalg.eigh(tensor)
        assert np.allclose(got.loc[k, ["e1", "e2", "e3"]].to_numpy(float), value[::-1])
        axis = got.loc[k, ["ax", "ay", "az"]].to_numpy(float)
        assert axis[2] >= 0 and np.allclose(tensor @ axis, value[2] * axis) and np.isclose(axis @ axis, 1)
