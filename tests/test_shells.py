"""Directions of equal area and threshold radii against NumPy."""

import numpy as np
import pandas as pd
import pytest

from skyframe.operators import shells


def test_directions_are_even(spark):
    for side in (1, 2, 4):
        d = shells.directions(spark, side).toPandas()
        x = d[["x", "y", "z"]].to_numpy()
        assert len(d) == 12 * side**2 and np.allclose((x**2).sum(1), 1) and np.allclose(x.mean(0), 0, atol=1e-12)
        assert np.allclose(x.T @ x / len(x), np.eye(3) / 3, atol=0.05)
        if side > 1:  # no two are close
            assert (x @ x.T - 2 * np.eye(len(x))).max() < np.cos(0.7 / side)


def brute(values, r, percent, rule, least=0.5, window=0.5, combine=4):
    q = values.copy()
    q[:, r < least] = np.nan
    q[q == 0] = np.nan
    if np.isnan(q).all():
        return [np.nan] * 5
    t = np.nanpercentile(q, percent)
    vote = np.where(np.isnan(q), False, q > t if rule == ">" else q < t)
    at = r[np.nonzero(vote)[1]]
    outer = np.array([r[np.flatnonzero(v)[-1]] for v in vote if v.any()])
    if not len(at):
        return [np.nan] * 5
    edges = r[::combine]
    p, pr = (edges[np.argmax(np.histogram(x, bins=edges)[0])] for x in (at, outer))
    near = lambda x, p: x[(x > p - window) & (x <= p + window)]
    return [np.median(x) if len(x) else np.nan for x in (near(at, p), at, near(at, pr), near(outer, pr), outer)]


@pytest.mark.parametrize("rule, percent, slope", [(">", 80, False), ("<", 30, False), (">", 90, True)])
def test_threshold_radii(spark, rule, percent, slope):
    rng, bins, low, step = np.random.default_rng(7), 30, 0.125, 0.125
    r, parts, want = low + step * np.arange(bins), [], {}
    for o in range(4):
        v = np.exp(-((r - 1.5 - 0.4 * o) ** 2) * 4)[None] + rng.normal(0, 0.2, (12, bins))
        v[rng.random(v.shape) < 0.1] = 0
        v = np.zeros_like(v) if o == 3 else v
        parts += [(o, ray, k, float(v[ray, k])) for ray in range(12) for k in range(bins)]
        want[o] = brute(np.gradient(v, 0.25, axis=1) if slope else v, r, percent, rule)
    df = spark.createDataFrame(parts, "o int, ray int, k int, v double")
    df = shells.radial_gradient(df, ["o", "ray"], "k", "v", 0.25) if slope else df
    got = shells.threshold_radii(df, "o", "ray", "k", "v", low, step, bins, percent, rule).toPandas().set_index("o")
    for o, w in want.items():
        assert np.allclose(got.loc[o, ["near_peak", "all_mid", "near_ray_peak", "ray_near_peak", "ray_mid"]].to_numpy(float), w, equal_nan=True), (o, w, got.loc[o])
    assert pd.isna(got.loc[3, "all_mid"])
