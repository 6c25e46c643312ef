"""Operators against brute force in NumPy, and their invariants."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyframe.functions import arrays as A
from skyframe.functions import columns as C
from skyframe.operators import binning, history, maps, membership, ordering, shapes, sightlines, spatial
from skyframe.operators.segments import components
from skyframe.sources.sinks import combine

RNG = np.random.default_rng(424242)
BOX = 100.0


@pytest.fixture(scope="module")
def points(spark):
    pdf = pd.DataFrame(RNG.uniform(0, BOX, (400, 3)), columns=list("xyz")).assign(id=range(400), mass=RNG.uniform(1, 2, 400), h=RNG.uniform(3, 10, 400))
    return pdf, spark.createDataFrame(pdf)


def distances(pdf):
    x = pdf[list("xyz")].to_numpy()
    d = np.abs(x[:, None] - x[None])
    d = np.minimum(d, BOX - d)
    return np.sqrt((d ** 2).sum(-1))


@pytest.mark.parametrize("radius", [5.0, 30.0, 60.0])
def test_radius_join_is_brute_force(points, radius):
    pdf, df = points
    got = spatial.radius_join(df, df, "id", "id", ["x", "y", "z"], BOX, radius).toPandas()
    want = np.argwhere(distances(pdf) <= radius)
    assert sorted(zip(got.center, got.point)) == sorted(map(tuple, want.tolist()))


def test_nearest_and_ties(points):
    pdf, df = points
    got = spatial.nearest(df, df, "id", "id", ["x", "y", "z"], BOX, 4, 3.0).toPandas().sort_values(["center", "rank"])
    d = distances(pdf)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :4]
    assert (got.point.to_numpy().reshape(-1, 4) == want).all()


def test_pair_counts_are_symmetric_and_complete(points):
    pdf, df = points
    edges = [0.0, 10.0, 20.0, 30.0]
    got = spatial.pair_counts(df, df, "id", "id", ["x", "y", "z"], BOX, edges, auto=True).toPandas().set_index("bin").dd
    d = distances(pdf)[~np.eye(400, dtype=bool)]
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        assert got[k] == ((d > a) & (d <= b)).sum()


def test_map_keeps_mass(points):
    pdf, df = points
    got = maps.mass_map(df, "x", "y", "h", "mass", BOX, 25).agg(F.sum("value")).first()[0]
    assert got == pytest.approx(pdf.mass.sum())
    small = maps.mass_map(df.withColumn("h", F.lit(0.01)), "x", "y", "h", "mass", BOX, 25)
    assert small.agg(F.sum("value")).first()[0] == pytest.approx(pdf.mass.sum())


def test_asymmetric_map_with_equal_sizes_is_the_round_one(points):
    _, df = points
    one = maps.mass_map(df, "x", "y", "h", "mass", BOX, 10).toPandas().set_index(["ix", "iy"]).value
    two = maps.mass_map(df, "x", "y", "h", "mass", BOX, 10, size_y="h").toPandas().set_index(["ix", "iy"]).value
    pd.testing.assert_series_equal(one.sort_index(), two.sort_index())


def test_ellipsoid_recovers_axes(spark):
    v = RNG.normal(size=(5000, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    x = v * RNG.uniform(9.9, 10.1, (5000, 1)) * [1, 0.8, 0.6]
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("xyz")).assign(k=1, m=1.0))
    r = shapes.ellipsoids(df, "k", ["x", "y", "z"], "m", 5.0, 12.0).first()
    assert r.q == pytest.approx(0.8, rel=0.03) and r.s == pytest.approx(0.6, rel=0.03)
    few = shapes.ellipsoids(df.limit(10), "k", ["x", "y", "z"], "m", 5.0, 12.0).first()
    assert few.q is None


def test_cuboid_remap_is_a_rigid_cover(points):
    pdf, df = points
    out = shapes.cuboid_remap(df, "id", ["x", "y", "z"], [[1, 1, 0], [0, 1, 0], [0, 0, 1]], BOX).toPandas()
    assert out[["x", "y", "z"]].notna().all().all()
    size = np.array([np.sqrt(2), 1 / np.sqrt(2), 1]) * BOX
    assert (out[["x", "y", "z"]].max().to_numpy() <= size).all() and np.prod(size) == pytest.approx(BOX ** 3)


def test_ray_tracing_is_nearest_generator(spark):
    pdf = pd.DataFrame({"ray": 1, "cell": range(60), "impact": RNG.uniform(0, 50, 60), "depth": RNG.uniform(0, BOX, 60)})
    got = sightlines.trace_rays(spark.createDataFrame(pdf), "ray", "cell", "impact", "depth", 0.0, BOX).toPandas().sort_values("seq")
    assert got.dl.sum() == pytest.approx(BOX)
    z = np.linspace(0.01, BOX - 0.01, 2000)
    want = pdf.cell.to_numpy()[np.argmin(pdf.impact.to_numpy() + (z[:, None] - pdf.depth.to_numpy()) ** 2, axis=1)]
    edges = np.cumsum(got.dl.to_numpy())
    assert (got.cell.to_numpy()[np.searchsorted(edges, z)] == want).mean() > 0.995


def test_synthetic_spectrum_scales_with_column(spark):
    cells = spark.createDataFrame([(1, 1e13, 1.0, 1e4, 0.0), (2, 2e13, 1.0, 1e4, 0.0), (3, 1.0, 1.0, 1e4, 0.0)], "ray long, n double, dl double, t double, v double")
    got = sightlines.synthetic_spectra(cells, "ray", "n", "dl", "t", "v", (-100, 100, 51), 1215.67, 0.4164, 6.265e8).groupBy("ray").agg(F.sum("tau").alias("s")).toPandas().set_index("ray").s
    assert got[2] == pytest.approx(2 * got[1]) and got[3] == 0 and got[1] > 0


@pytest.mark.parametrize("n", [1, 7, 60])
def test_components_of_chains_and_loops(spark, n):
    edges = [(i, i + 1) for i in range(n - 1)] + [(1000, 1001), (1001, 1002), (1002, 1000)]
    nodes = [(i,) for i in [*range(n), 1000, 1001, 1002, 5000]]
    got = components(spark.createDataFrame(nodes, "id long"), spark.createDataFrame(edges, "a long, b long")).toPandas().set_index("id").label
    assert (got[got.index < 1000] == 0).all() and (got[[1000, 1001, 1002]] == 1000).all() and got[5000] == 5000


def test_prefix_sum_is_independent_of_buckets(spark):
    df = spark.range(500).select("id", (F.col("id") * 7 % 13).alias("v"))
    for width in (1, 50, 1000):
        got = ordering.prefix_sum(df, "v", ["id"], F.floor(F.col("id") / width)).toPandas().sort_values("id")
        assert (got.total.to_numpy() == np.cumsum(np.arange(500) * 7 % 13)).all()


def test_interval_lookup_flags_unowned_rows(spark):
    rows = spark.range(30).withColumnRenamed("id", "row")
    spans = spark.createDataFrame([(1, 0, 5), (2, 5, 0), (3, 8, 15)], "obj long, start long, len long")
    for width in (1, 4, 100):
        got = membership.interval_lookup(rows, spans, "row", "start", "len", ["obj"], width).toPandas().set_index("row").obj.sort_index()
        assert (got[:5] == 1).all() and got[5:8].isna().all() and (got[8:23] == 3).all() and got[23:].isna().all()


def test_array_functions(spark):
    df = spark.createDataFrame([([0.0, 1.0, 0.0],), ([0.0, 0.0, 0.0],)], "a array<double>")
    r = df.select(A.last_nonzero("a"), A.equivalent_width("a"), A.v90("a")).collect()
    assert r[0][0] == 1 and r[1][0] == -1
    assert r[0][1] == pytest.approx(1 - np.exp(-1)) and r[1][2] == 0.0


def test_resampling_keeps_absorbed_flux(spark):
    tau = [0.0] * 10 + [3.0] * 6 + [0.0] * 16
    r = spark.createDataFrame([(tau,)], "a array<double>").select(A.equivalent_width("a", 1.0), A.resampled("a", 4)).first()
    assert sum(1 - np.exp(-np.array(r[1]))) * 4 == pytest.approx(r[0])


def test_bin_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (None,)], "x double")
    got = [[r[k] for r in df.select(C.bin_index("x", 0, 2, 2), C.bin_index("x", 0, 2, 2, closed="numpy"), C.bin_index("x", 0, 2, 2, closed="right")).collect()] for k in range(3)]
    assert got == [[0, 1, None, None], [0, 1, 1, None], [None, 0, 1, None]]


def test_running_median_merges_sparse_bins(spark):
    df = spark.createDataFrame([(float(x), float(x)) for x in [*([0] * 20), *([1] * 3), *([5] * 30), 9]], "x double, y double")
    edges = binning.adaptive_edges(df, "x", 10, 10)
    out = binning.running(df, "x", "y", edges).toPandas()
    assert out.n.sum() == 54 and (out.n >= 10).all()


def test_gap_filling_and_crossing(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (1, 3, 0.5), (2, 0, 0.1), (3, 0, 9.0)], "k int, t int, r double")
    full = history.fill_gaps(df, "k", "t", ["r"]).toPandas()
    assert full[(full.k == 1) & (full.t == 2)].r.iloc[0] == pytest.approx(1.0) and full.ghost.sum() == 2
    acc = history.first_inside(df.withColumn("time", F.col("t") * 1.0), "k", "t", "time", "r", 1.0, "acc").toPandas().set_index("k").acc
    assert acc[1] == pytest.approx(2.0) and acc[2] == 0.0 and np.isnan(acc[3])


def test_combine_rejects_shared_keys(spark):
    a = spark.range(5)
    assert combine([a, spark.range(5, 9)], "id").count() == 9
    with pytest.raises(ValueError):
        combine([a, spark.range(4, 9)], "id")


def crowd_of(spark, n=300):
    """Two thirds of the points in one small cell, the others anywhere."""
    x = np.vstack([RNG.uniform(40, 41, (2 * n // 3, 3)), RNG.uniform(0, BOX, (n - 2 * n // 3, 3))])
    pdf = pd.DataFrame(x, columns=list("xyz")).assign(id=range(n))
    return pdf, spark.createDataFrame(pdf)


def test_crowded_cells_are_cut_into_blocks(spark):
    pdf, df = crowd_of(spark)
    for radius in (0.5, 30.0, 60.0):
        want = sorted(map(tuple, np.argwhere(distances(pdf) <= radius).tolist()))
        got = spatial.radius_join(df, df, "id", "id", ["x", "y", "z"], BOX, radius, crowd=20).toPandas()
        assert sorted(zip(got.center, got.point)) == want
        half = spatial.radius_join(df, df, "id", "id", ["x", "y", "z"], BOX, radius, crowd=20, half=True).toPandas()
        assert len(half) * 2 == len(want) - len(pdf) and set(zip(half.center, half.point)) | set(zip(half.point, half.center)) == {p for p in want if p[0] != p[1]}


def test_open_space(spark):
    pdf, df = crowd_of(spark)
    pdf[["x", "y"]] -= 45.0
    df = spark.createDataFrame(pdf)
    x = pdf[list("xyz")].to_numpy()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    got = spatial.radius_join(df, df, "id", "id", ["x", "y", "z"], 0, 7.0).toPandas()
    assert sorted(zip(got.center, got.point)) == sorted(map(tuple, np.argwhere(d <= 7.0).tolist()))
    got = spatial.nearest(df, df, "id", "id", ["x", "y", "z"], 0, 3, 2.0, crowd=50).toPandas().sort_values(["center", "rank"])
    np.fill_diagonal(d, np.inf)
    assert (got.point.to_numpy().reshape(-1, 3) == np.argsort(d, axis=1, kind="stable")[:, :3]).all()


def test_nearest_with_fewer_points_than_asked(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0, 1.0), (1, 99.0, 99.0, 99.0), (2, 50.0, 50.0, 50.0)], "id long, x double, y double, z double")
    got = spatial.nearest(df, df, "id", "id", ["x", "y", "z"], BOX, 5, 1.0).toPandas()
    assert got.groupby("center").size().to_dict() == {0: 2, 1: 2, 2: 2}
    assert got[(got.center == 0) & (got["rank"] == 1)].distance.iloc[0] == pytest.approx(np.sqrt(12))
    assert spatial.nearest(df.limit(0), df, "id", "id", ["x", "y", "z"], BOX, 1, 1.0).count() == 0


def test_positional_match_takes_the_nearest_and_then_the_mass(spark):
    kind = "id long, x double, y double, z double, m double"
    a = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 10.0), (2, 50.0, 0.0, 0.0, 10.0)], kind)
    b = spark.createDataFrame([(7, 3.0, 0.0, 0.0, 1000.0), (8, 5.0, 0.0, 0.0, 10.0), (9, 70.0, 0.0, 0.0, 15.0)], kind)
    got = spatial.positional_match(a, b, "id", ["x", "y", "z"], BOX, "m", 0.3, 5.0).toPandas().set_index("id").other
    assert got[1] == -1 and got[2] == 9  # a heavier nearest is not replaced by the next; distance does not matter


def test_shrinking_center_is_periodic(spark):
    x = np.vstack([RNG.normal(2, 0.3, (200, 3)), RNG.uniform(0, 10, (60, 3))])
    got = shapes.shrinking_centers(spark.createDataFrame(pd.DataFrame(x, columns=list("xyz")).assign(k=1)), "k", ["x", "y", "z"], 10.0).first()
    kept = x
    for _ in range(100):
        c, n = kept.mean(0), int(len(kept) * 0.95)
        if n in (0, len(kept)) or len(kept) <= 26:
            break
        gap = np.abs(kept - c)
        kept = kept[np.argsort((np.minimum(gap, 10 - gap) ** 2).sum(1))[:n]]
    assert np.allclose([got.x, got.y, got.z], c) and np.allclose(c, 2, atol=0.2)
    one = shapes.shrinking_centers(spark.createDataFrame([(1, 9.9, 0.1)], "k long, x double, y double"), "k", ["x", "y"], 10.0).first()
    assert (one.x, one.y) == (9.9, 0.1)


def test_even_sample_repeats_positions(spark):
    df = spark.range(100).withColumnRenamed("id", "i")
    assert sorted(r.i for r in ordering.even_sample(df, "i", 100, 5).collect()) == [0, 24, 49, 74, 99]
    assert sorted(r.i for r in ordering.even_sample(df, "i", 100, 7, log=True).collect()) == sorted(np.logspace(0, np.log10(99), 7).astype(int).tolist())
    assert ordering.even_sample(df.limit(3), "i", 3, 5).count() == 3
