"""Maps and grids: kernel deposition, projections, pyramids, columns in front of targets."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import min_image


def kernel(u: Column, flat: bool = True) -> Column:
    """Cubic spline in u = r / h, without its constant (weights are normalised per row)."""
    inner = 1 - 6 * u * u + 6 * u * u * u
    outer = 2 * F.pow(1 - u, F.lit(3.0))
    return F.when(u < 0.5, inner).when(u < 1, outer).otherwise(F.lit(0.0))


def deposit(rows: DataFrame, x: str, y: str, size: str, mass: str, box: float, pixels: int, key: list[str] = (), most: int = 500, size_y: str | None = None) -> DataFrame:
    """A mass map: each row is spread over the pixels whose centers are within its size, its weights adding to one.

    A row smaller than its pixel goes into that pixel.  Periodic; sizes are cut at `most` pixels.  Rows become
    (pixel, share) by explode, and each task adds up its pixels before the shuffle.
    """
    p = box / pixels
    h = lambda c: F.least(F.col(c), F.lit(most * p))
    hx, hy = h(size), h(size_y or size)
    df = rows.select(*key, F.col(x).alias("_x"), F.col(y).alias("_y"), hx.alias("_hx"), hy.alias("_hy"), F.col(mass).alias("_m"))
    df = df.withColumns({"_px": F.floor(F.col("_x") / p), "_py": F.floor(F.col("_y") / p)})
    reach = lambda c, h: F.ceil(F.col(h) / p)
    steps = F.transform(F.sequence(-reach("_x", "_hx"), reach("_x", "_hx")), lambda i: F.transform(F.sequence(-reach("_y", "_hy"), reach("_y", "_hy")), lambda j: F.struct(i.alias("i"), j.alias("j"))))
    cells = F.transform(F.flatten(steps), lambda s: F.struct(
        F.pmod(F.col("_px") + s["i"], F.lit(pixels)).cast("int").alias("ix"), F.pmod(F.col("_py") + s["j"], F.lit(pixels)).cast("int").alias("iy"),
        kernel(F.sqrt(F.pow(((F.col("_px") + s["i"] + 0.5) * p - F.col("_x")) / F.col("_hx"), F.lit(2.0)) + F.pow(((F.col("_py") + s["j"] + 0.5) * p - F.col("_y")) / F.col("_hy"), F.lit(2.0)))).alias("w")))
    spread = F.filter(cells, lambda c: c["w"] > 0)
    own = F.array(F.struct(F.pmod("_px", F.lit(pixels)).cast("int").alias("ix"), F.pmod("_py", F.lit(pixels)).cast("int").alias("iy"), F.lit(1.0).alias("w")))
    df = df.withColumn("_c", spread).withColumn("_c", F.when(F.size("_c") == 0, own).otherwise(F.col("_c")))
    df = df.withColumn("_t", F.aggregate("_c", F.lit(0.0), lambda s, c: s + c["w"]))
    return df.select(*key, F.explode("_c").alias("_p"), "_m", "_t").select(*key, F.col("_p.ix").alias("ix"), F.col("_p.iy").alias("iy"), (F.col("_m") * F.col("_p.w") / F.col("_t")).alias("share"))


def mass_map(rows: DataFrame, x: str, y: str, size: str, mass: str, box: float, pixels: int, most: int = 500, size_y: str | None = None, spread: int | None = None) -> DataFrame:
    """(ix, iy, value): the sum of deposit() for each pixel, by a vectorised kernel.

    Each task adds up its rows' shares and sends one row for each pixel that it has met, in parts of at most about a
    million pixels, so that a task's memory does not grow with the map.  `spread` deals the rows to that many tasks
    first; a table of many files needs no such shuffle.
    """
    p = box / pixels

    def packed(total):
        cells = np.fromiter(total, np.int64, len(total))
        cols = [pa.array((cells // pixels).astype(np.int32)), pa.array((cells % pixels).astype(np.int32)), pa.array(list(total.values()), pa.float64())]
        return pa.RecordBatch.from_arrays(cols, names=["ix", "iy", "value"])

    def run(batches):
        total: dict[int, float] = {}
        for batch in batches:
            px, py, hx, hy, m = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(5))
            hx, hy = np.minimum(hx, most * p), np.minimum(hy, most * p)
            cx, cy = np.floor(px / p), np.floor(py / p)
            reach = np.stack([np.ceil(hx / p), np.ceil(hy / p)], axis=1).astype(int)
            for rx, ry in np.unique(reach, axis=0).tolist():
                same = np.flatnonzero((reach[:, 0] == rx) & (reach[:, 1] == ry))
                i, j = (g.ravel()[None, :] for g in np.meshgrid(np.arange(-rx, rx + 1), np.arange(-ry, ry + 1), indexing="ij"))
                for at in range(0, len(same), step := max(1, 2_000_000 // i.size)):
                    k = same[at : at + step, None]
                    u = np.sqrt((((cx[k] + i + 0.5) * p - px[k]) / hx[k]) ** 2 + (((cy[k] + j + 0.5) * p - py[k]) / hy[k]) ** 2)
                    w = np.where(u < 0.5, 1 - 6 * u * u + 6 * u ** 3, np.where(u < 1, 2 * np.maximum(1 - u, 0) ** 3, 0.0))
                    full = w.sum(1, keepdims=True)
                    w = np.where(full > 0, w, (i == 0) & (j == 0))  # smaller than its pixel: all into that
                    share = m[k] * w / np.where(full > 0, full, 1.0)
                    pixel = ((cx[k] + i) % pixels * pixels + (cy[k] + j) % pixels).astype(np.int64)
                    some, where = np.unique(pixel[w > 0], return_inverse=True)
                    for a, b in zip(some.tolist(), np.bincount(where, share[w > 0]).tolist()):
                        total[a] = total.get(a, 0.0) + b
                    if len(total) > 1_000_000:
                        yield packed(total)
                        total = {}
        yield packed(total)

    some = rows.select(*(F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate((x, y, size, size_y or size, mass))))
    some = some.repartition(spread) if spread else some
    return some.mapInArrow(run, "ix int, iy int, value double").groupBy("ix", "iy").agg(F.sum("value").alias("value"))


def level_grid(rows: DataFrame, pos: list[str], size: str, mass: str, box: float, finest: int, levels: int) -> DataFrame:
    """(level, i<dim>..., value): rows deposited on periodic grids of 1, 2, 4, ... times the finest pixel, in 2-D or 3-D.

    A row goes to the level whose pixel is the first of at least half its size (the last one if none is), so it meets
    a few pixels in each direction however large it is.  Its shares are the kernel at the pixels' centers, adding to
    one; a row smaller than its pixel goes into that one.  `finest` must be divisible by 2^(levels - 1).
    """
    if finest % (1 << (levels - 1)):
        raise ValueError("finest must be divisible by 2^(levels - 1)")
    dims, p0 = len(pos), box / finest

    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(dims)], axis=1) % box
            h, m = (batch.column(dims + k).to_numpy(zero_copy_only=False).astype(float) for k in range(2))
            level = np.clip(np.ceil(np.log2(np.maximum(h / (2 * p0), 1e-300))), 0, levels - 1).astype(int)
            reach = np.ceil(h / (p0 * 2.0**level)).astype(int)
            for at_level, r in np.unique(np.stack([level, reach], axis=1), axis=0).tolist():
                same, p, n = np.flatnonzero((level == at_level) & (reach == r)), p0 * (1 << at_level), finest >> at_level
                step = np.stack([g.ravel() for g in np.meshgrid(*[np.arange(-r, r + 1)] * dims, indexing="ij")], axis=1)
                for a in range(0, len(same), many := max(1, 500_000 // len(step))):
                    k = same[a : a + many]
                    cell = np.floor(x[k] / p)[:, None, :] + step[None]
                    u = np.sqrt((((cell + 0.5) * p - x[k][:, None, :]) ** 2).sum(2)) / np.maximum(h[k], 1e-300)[:, None]
                    w = np.where(u < 0.5, 1 - 6 * u * u + 6 * u**3, np.where(u < 1, 2 * np.maximum(1 - u, 0) ** 3, 0.0))
                    full = w.sum(1, keepdims=True)
                    w = np.where(full > 0, w, (step == 0).all(1)[None])
                    share = m[k][:, None] * w / np.where(full > 0, full, 1.0)
                    number = np.ravel_multi_index(tuple((cell % n).astype(np.int64)[..., d] for d in range(dims)), (n,) * dims)
                    some, where = np.unique(number[w > 0], return_inverse=True)
                    places = np.unravel_index(some, (n,) * dims)
                    cols = [pa.array(np.full(len(some), at_level, np.int32)), *(pa.array(i.astype(np.int32)) for i in places), pa.array(np.bincount(where, share[w > 0], len(some)))]
                    yield pa.RecordBatch.from_arrays(cols, names=["level", *names, "value"])

    names = [f"i{d}" for d in pos]
    some = rows.select(*(F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate((*pos, size, mass))))
    return some.mapInArrow(run, f"level int, {', '.join(f'{n} int' for n in names)}, value double").groupBy("level", *names).agg(F.sum("value").alias("value"))


def refined(grid: DataFrame, names: list[str]) -> DataFrame:
    """level_grid() on its finest grid: (names, value); a coarse pixel's value is shared evenly by those it consists of."""
    children = F.pow(F.lit(2.0), F.col("level")).cast("int")
    out = grid
    for n in names:
        out = out.withColumn(n, F.explode(F.transform(F.sequence(F.lit(0), children - 1), lambda k: F.col(n) * children + k)))  # noqa: B023
    return out.groupBy(*names).agg(F.sum(F.col("value") / F.pow(children, F.lit(float(len(names))))).alias("value"))


def pyramid(image: DataFrame, levels: int) -> DataFrame:
    """Means of 2 x 2 pixels, level by level; level 0 is the image."""
    out, now = image.select(F.lit(0).alias("level"), "ix", "iy", "value"), image
    for k in range(1, levels + 1):
        now = now.groupBy(F.floor(F.col("ix") / 2).cast("int").alias("ix"), F.floor(F.col("iy") / 2).cast("int").alias("iy")).agg(F.avg("value").alias("value"))
        out = out.unionByName(now.select(F.lit(k).alias("level"), "ix", "iy", "value"))
    return out


def folded_angle(dx: Column, dy: Column) -> Column:
    """Angle from the x axis, folded into 0 to 90 degrees."""
    return F.degrees(F.atan2(F.abs(dy), F.abs(dx)))


def pixel_distance(ix: Column, iy: Column, cx: float, cy: float, p: float, box: float) -> Column:
    return F.sqrt(F.pow(min_image((ix + 0.5) * p - cx, box), F.lit(2.0)) + F.pow(min_image((iy + 0.5) * p - cy, box), F.lit(2.0)))


def ring_area(edges: list[float]) -> list[float]:
    return [math.pi * (b * b - a * a) for a, b in zip(edges, edges[1:])]
