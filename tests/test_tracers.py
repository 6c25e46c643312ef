"""Parents, modes of accretion, formation, smoothing and crossing events on small tables made by hand, and against NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyframe.operators import history, tracers


def test_typed_parents_by_precedence(spark):
    rows = spark.createDataFrame([(1, 0, 7), (2, 0, 8), (3, 1, 7), (4, 0, 99), (5, 0, None)], "t long, snap int, parent long")
    ids = spark.createDataFrame([(0, "bh", 7, 1), (0, "gas", 7, 2), (0, "gas", 7, 5), (0, "stars", 8, 3), (1, "stars", 7, 4), (0, "tracer", 99, 6)], "snap int, kind string, id long, obj long")
    got = {r.t: (r.kind, r.obj) for r in tracers.typed_parents(rows, ids, ["gas", "stars", "bh"], "snap", "parent", ["obj"]).collect()}
    assert got == {1: ("gas", 2), 2: ("stars", 3), 3: ("stars", 4), 4: (None, None), 5: (None, None)}
    assert {r.t: r.kind for r in tracers.typed_parents(rows, ids, ["bh", "gas"], "snap", "parent", ["obj"]).collect()}[1] == "bh"
    with pytest.raises(ValueError, match="1 rows"):
        tracers.typed_parents(rows, ids, ["gas", "stars", "bh"], "snap", "parent", ["obj"], missing="error")
    assert tracers.typed_parents(rows.where("t <> 4"), ids, ["gas", "stars", "bh"], "snap", "parent", ["obj"], missing="error").count() == 4


def test_accretion_modes(spark):
    """Each tracer: its objects at snapshots 0, 1, 2, ..., its branch's objects (None: no row), the snapshot of entry."""
    cases = {
        "smooth": [([5, -1, 3, 3], [None, None, 3, 3], 0), ([-1, -1, 3, 3], [None, 3, 3, 3], 2), ([3, 3, 3, 9], [3, 3, 3, 3], 2)],
        "stripped": [([4, -1, 3], [3, 3, 3], 2), ([8, 3, 3], [None, 3, 3], 2)],
        "merger": [([3, 3, 4], [3, 3, 3], 2), ([3, 3, -1], [3, 3, 3], 2)],
        "none": [([3, 3, 3], [3, 3, 3], None), ([3, 3, 3], [None, None, None], 2), ([3, 3, 3], [3, None, 3], 1)],
    }
    parents, branch, entered, want = [], [], [], {}
    for mode, some in cases.items():
        for objs, main, acc in some:
            t = len(want)
            want[t] = mode
            parents += [(t, s, o) for s, o in enumerate(objs)]
            branch += [(t, s, o) for s, o in enumerate(main) if o is not None]
            entered.append((t, acc))
    shape = "tracer long, snap int, obj long"
    got = tracers.accretion_modes(spark.createDataFrame(parents, shape), spark.createDataFrame(branch, shape), spark.createDataFrame(entered, "tracer long, acc int"))
    assert {r.tracer: r.mode for r in got.collect()} == want


def test_branch_of_final_and_formation(spark):
    parents = spark.createDataFrame([(1, 0, 9), (1, 5, 4), (2, 5, -1), (3, 5, 6), (4, 1, 4)], "tracer long, snap int, obj long")
    halo_of = spark.createDataFrame([(4, 2, 3), (3, 2, 3), (6, 3, 6)], "obj long, halo long, first_obj long")
    branch = spark.createDataFrame([(3, 5, 3), (3, 4, 30)], "root long, snap int, obj long")
    got = sorted(map(tuple, tracers.branch_of_final(parents, halo_of, branch).collect()), key=str)
    assert got == sorted([(1, 3, 5, 3), (1, 3, 4, 30), (2, -1, None, -1), (3, -1, None, -1), (4, 3, 5, 3), (4, 3, 4, 30)], key=str)
    rows = spark.createDataFrame([(1, 3, 70, 1, 1.0, 10.0, 4.0), (1, 2, 71, 1, 99.0, 10.0, 5.0), (2, 2, 72, 1, 3.0, 8.0, 2.0), (3, 2, 73, 2, 3.0, 8.0, 2.0), (4, 2, 74, 9, 1.0, 8.0, 2.0)], "root long, snap int, sub long, halo long, x double, mass double, dm double")
    halos = spark.createDataFrame([(2, 1, 71, 99.0, 2.0), (2, 2, 70, 9.0, 0.0)], "snap int, halo long, first_sub long, x double, rvir double")
    got = {r.root: tuple(r)[1:] for r in tracers.at_formation(rows, halos, ["x"], 100.0).collect()}
    assert got == {1: (2, 0, 0.0, 0.5), 2: (2, 1, 2.0, 0.25), 3: (2, 1, float("inf"), 0.25), 4: (2, None, None, 0.25)}


@pytest.mark.parametrize("order", [1, 3, 5])
def test_polynomial_is_least_squares(spark, order):
    rng = np.random.default_rng(order)
    pdf = pd.concat([pd.DataFrame({"k": k, "t": np.sort(rng.choice(np.arange(1000, 1090), 40, replace=False)) + 0.0, "v": rng.normal(size=40)}) for k in range(3)] + [pd.DataFrame({"k": 9, "t": [5.0], "v": [2.5]})])
    got = history.polynomial(spark.createDataFrame(pdf), "k", "t", "v", order, "fit").toPandas()
    for k, one in got.groupby("k"):
        one = one.sort_values("t")
        u = one.t - one.t.mean()
        want = np.polyval(np.polyfit(u, one.v, order), u) if k < 9 else [2.5]
        assert np.allclose(one.fit, want, atol=1e-6)


def test_evened_steps(spark):
    a = [1, 2, 4, 8, 8.5, 9, 9.5, 10, 20, 21, 42, 84]
    df = spark.createDataFrame([(k, i, float(x)) for k in (1, 2) for i, x in enumerate(a)], "k long, i int, a double")
    step = np.diff(np.log10(a), prepend=np.nan)
    step[0] = step[1]
    small = step < 0.8 * np.median(step)
    want, run = [], 0
    for i, s in enumerate(small):
        run = run + 1 if s else 0
        alone = s and not (i and small[i - 1]) and not (i + 1 < len(a) and small[i + 1])
        if not s or alone or run % 2 == 0:
            want.append(i)
    got = history.evened_steps(df, "k", "i", "a").toPandas()
    assert len(want) < len(a) and all(sorted(g.i) == want for _, g in got.groupby("k"))


def test_stays_above_moving_boundaries(spark):
    tracks = {1: [0.0, 0.5, 2.0, 3.0, 1.0, 0.2, 4.0], 2: [3.0, 3.0, 0.1], 3: [0.1, 0.2, 0.1], 4: [1.2, 1.0, 1.1], 5: [2.5]}
    df = spark.createDataFrame([(k, 2 * i, v) for k, some in tracks.items() for i, v in enumerate(some)], "k long, t int, v double")
    got = sorted(map(tuple, history.stays_above(df, "k", "t", "v", (0.4, 0.05), (1.5, 0.1)).collect()), key=lambda r: r[:3])
    low, high = lambda t: 0.4 + 0.05 * t, lambda t: 1.5 + 0.1 * t
    want = []
    for k, some in tracks.items():
        fine = np.linspace(0, 2 * (len(some) - 1), 200_001) if len(some) > 1 else np.zeros(1)
        v = np.interp(fine, 2 * np.arange(len(some)), some)
        above = v >= high(fine)
        edges = np.flatnonzero(np.diff(above.astype(int), prepend=0))
        starts, stops = fine[edges[::2]], list(fine[edges[1::2]])
        want += [(k, "above", n + 1, s, stops[n] if n < len(stops) else None) for n, s in enumerate(starts)]
        if v[0] < low(0):
            out = fine[v >= low(fine)]
            want.append((k, "below", 1, 0.0, out[0] if len(out) else None))
    want.sort(key=lambda r: r[:3])
    assert [r[:3] for r in got] == [r[:3] for r in want]
    for g, w in zip(got, want):
        assert g[3] == pytest.approx(w[3], abs=1e-3) and (g[4] is None if w[4] is None else g[4] == pytest.approx(w[4], abs=1e-3))
    assert history.stays_above(df.where(F.lit(False)), "k", "t", "v", (0.4, 0.05), (1.5, 0.1)).count() == 0
