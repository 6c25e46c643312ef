"""Jobs over all objects against brute force on a small table, as DuckDB is slow on all pairs."""

import math

import numpy as np
import pytest

from skyframe.plans import roles
from skyframe.queries import load_all

load_all()
BOX = 1000.0


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Orders so few that many have no neighbour, and some have several."""
    rng = np.random.default_rng(8)
    keys = rng.choice(5000, 260, replace=False) + 1
    rows = [(int(k), int(rng.integers(1, 40)), float(round(rng.uniform(3e4, 5e5), 2)), "1-URGENT") for k in keys]
    path = str(tmp_path_factory.mktemp("small"))
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string").write.parquet(f"{path}/orders.parquet")
    subs = roles.Tables(spark, path).subs.toPandas().sort_values("sub_id", ignore_index=True)
    gap = np.abs(subs[list("xyz")].to_numpy()[:, None] - subs[list("xyz")].to_numpy()[None])
    d = np.sqrt((np.minimum(gap, BOX - gap) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    return path, subs, d


def run(spark, name, path):
    return roles.QUERIES[name](spark, path).toPandas()


def test_every_object_is_a_center(spark, small):
    path, subs, d = small
    ids, mass = subs.sub_id.to_numpy(), subs.mass.to_numpy()
    got = run(spark, "j24_radius_join", path)
    assert set(zip(got.center, got.point)) == {(ids[i], ids[j]) for i, j in np.argwhere(d <= 60)}
    got = run(spark, "a19_neighbour_statistics", path).set_index("center").loc[ids]
    near = d <= 120
    assert (~near.any(1)).sum() > 10 and len(got) == len(ids)
    assert (got.n.to_numpy() == near.sum(1)).all() and np.allclose(got.total, (near * mass).sum(1))
    assert got.lo.isna().to_numpy().tolist() == (~near.any(1)).tolist()
    ratio = mass[None] / mass[:, None]
    want = (near & (mass > 50000) & (mass < 400000) & (ratio > 0.5) & (ratio < 2)).sum(1)
    assert (run(spark, "a20_restricted_neighbours", path).set_index("center").loc[ids].n.to_numpy() == want).all()


@pytest.mark.parametrize("name, zero, at", [("a21_neighbour_profiles", True, lambda d: np.floor(d / 20)), ("a22_reductions_in_bins", False, lambda d: np.ceil(d / 20) - 1)])
def test_profiles_of_every_object(spark, small, name, zero, at):
    path, subs, d = small
    ids, mass, want = subs.sub_id.to_numpy(), subs.mass.to_numpy(), {}
    for i, j in np.argwhere((d < 120) & ((d > 0) | zero)):
        want[ids[i], int(at(d[i, j]))] = want.get((ids[i], int(at(d[i, j]))), 0) + mass[j]
    got = run(spark, f"{name}", path)
    total = got["mass" if "mass" in got else "total"]
    assert {k: pytest.approx(v, abs=0.02) for k, v in want.items()} == dict(zip(zip(got.center, got.bin), total))


def test_pairs_of_all_points(spark, small):
    path, subs, d = small
    n, k = len(subs), np.maximum(np.ceil(np.where(np.isinf(d), 1e9, d) / 20) - 1, 0).astype(int)
    shell = lambda b: 4 / 3 * math.pi * 20 ** 3 * ((b + 1) ** 3 - b ** 3)
    want = {b: (k == b).sum() for b in range(6) if (k == b).any()}
    got = run(spark, "a55_two_point_correlation", path)
    assert dict(zip(got.bin, got.dd)) == want
    assert np.allclose(got.xi, [want[b] / (shell(b) * n * n / BOX ** 3) - 1 for b in got.bin])
    cube = (subs.x // 500 * 4 + subs.y // 500 * 2 + subs.z // 500).to_numpy()
    got = run(spark, "a56_jackknife", path)
    for r in got.itertuples():
        keep = cube != r.cube
        assert r.dd == (k[keep][:, keep] == r.bin).sum()
    got = run(spark, "a57_split_correlation", path)
    w = subs.mass.to_numpy() / 1e5
    for r in got.itertuples():
        rows = (subs.sub_id % 5 == r.split).to_numpy()
        assert r.dd == pytest.approx((np.outer(w, w) * (k == r.bin))[rows].sum(), abs=1e-3)


def test_direction_samples(spark, small):
    path, subs, _ = small
    got = run(spark, "a83_direction_samples", path).set_index("sample")
    assert len(got) == 18 * len(subs)
    ways = {1: (1, 0, 0), -1: (-1, 0, 0), 2: (0, 1, 0), -2: (0, -1, 0), 3: (0, 0, 1), -3: (0, 0, -1)}
    places = subs[list("xyz")].to_numpy()
    for s in subs.head(40).itertuples():
        for r in (20, 60, 180):
            for k, way in ways.items():
                gap = np.abs((np.array([s.x, s.y, s.z]) + r * np.array(way)) % BOX - places)
                d = np.sqrt((np.minimum(gap, BOX - gap) ** 2).sum(1))
                near = np.lexsort((subs.sub_id, d))[:8]
                u = d[near] / d[near].max()
                w = np.where(u < 0.5, 1 - 6 * u ** 2 * (1 - u), 2 * (1 - u) ** 3)
                row = got.loc[s.sub_id * 1000 + r * 4 + k]
                assert row.distance == pytest.approx(d[near].max(), abs=1e-5)
                assert row.mass == pytest.approx((w * subs.mass.to_numpy()[near]).sum() / w.sum(), rel=1e-6)


def test_comoving_distance_by_quadrature(spark):
    rows = roles.QUERIES["f18b_comoving_distance"](spark, "/root/testdata/sf0.001").select("snap", "mpc").distinct().collect()
    assert len(rows) == len({r.snap for r in rows}) > 5
    for r in rows:
        z = np.linspace(0, (29 - r.snap) / 10, 20001)
        inverse = 1 / np.sqrt(0.3089 * (1 + z) ** 3 + 1 - 0.3089)
        want = 299792.458 / 67.74 * ((inverse[1:] + inverse[:-1]) / 2 * np.diff(z)).sum()
        assert r.mpc == pytest.approx(want, rel=1e-3)
