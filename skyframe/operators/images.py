"""Shape statistics of images, one row for each pixel: concentration of light, the brightest pixels' moment, bounding ellipses."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def brightest_share(pixels: DataFrame, key: str, value: str, share: float, levels: int = 1024) -> DataFrame:
    """(key, threshold): the value from which on the running sum of an image's values, faintest first, is at least `share` of all.

    In two levels: sums in steps of the value's range find the step that the share is reached in, and only
    that step's pixels are ordered, so an image may have any number of pixels.  Equal values share a step.
    """
    rows = pixels.select(key, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    span = rows.groupBy(key).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_v").alias("_all"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * levels), F.lit(levels - 1))).otherwise(F.lit(0))
    rows = rows.join(span, key).withColumn("_at", at)
    steps = rows.groupBy(key, "_at", "_all").agg(F.sum("_v").alias("_s"))
    upto = Window.partitionBy(key).orderBy("_at")  # at most `levels` rows an image
    steps = steps.withColumn("_upto", F.sum("_s").over(upto)).where(F.col("_upto") >= share * F.col("_all"))
    first = steps.groupBy(key).agg(F.min(F.struct("_at", (F.col("_upto") - F.col("_s")).alias("_before"))).alias("_f")).select(key, "_f.*")
    last = rows.join(first, [key, "_at"]).groupBy(key, "_before", "_all", "_v").agg(F.count(F.lit(1)).alias("_n"))  # equal values are one
    within = Window.partitionBy(key).orderBy("_v")
    # The first pixel of several equal ones that reaches the share has their value.
    reached = last.withColumn("_c", F.col("_before") + F.sum(F.col("_v") * F.col("_n")).over(within)).where(F.col("_c") >= share * F.col("_all"))
    return reached.groupBy(key).agg(F.min("_v").alias("threshold"))


def m20(pixels: DataFrame, key: str, x: str, y: str, value: str, share: float = 0.8) -> DataFrame:
    """(key, m20): log10 of the second moment of the pixels with the brightest 1 - share of the light over that of all pixels.

    Moments are about the image's center of light; null where either is not over 0 (a missing pixel has no light).
    """
    v = F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = pixels.select(key, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), v.alias("_v"))
    rows = rows.join(brightest_share(rows, key, "_v", share), key, "left")

    def moment(light):
        cx, cy = (F.try_divide(F.sum(F.col(c) * F.col("_v")), F.sum("_v")) for c in ("_x", "_y"))
        return F.sum(F.col("_x") * F.col("_x") * light) - cx * F.sum(F.col("_x") * light) + F.sum(F.col("_y") * F.col("_y") * light) - cy * F.sum(F.col("_y") * light)

    bright = F.when(F.col("_v") >= F.col("threshold"), F.col("_v")).otherwise(F.lit(0.0))
    sums = rows.groupBy(key).agg(moment(F.col("_v")).alias("_t"), moment(bright).alias("_b"))
    return sums.select(key, F.when((F.col("_t") > 0) & (F.col("_b") > 0), F.log10(F.try_divide("_b", "_t"))).alias("m20"))


def bounding_ellipses(pixels: DataFrame, key: str, x: str, y: str, value: str, level: float, close: float = 0.005, rounds: int = 1000) -> DataFrame:
    """(key, major, minor, angle, cx, cy): the ellipse of least area around an image's pixels of at least `level`.

    Weights move to the point farthest out until they settle.  Only corners of the convex hull can touch the ellipse,
    so an image is reduced before it is gathered: to the lowest and the highest y of each x.  Fewer than three points,
    or points on one line, give nulls.  The angle is of the major axis, in degrees from x, in [0, 180).
    """
    kind = pixels.schema[key].dataType.simpleString()
    ends = pixels.where(F.col(value) >= level).groupBy(key, F.col(x).cast("double").alias("_x")).agg(F.min(F.col(y).cast("double")).alias("_lo"), F.max(F.col(y).cast("double")).alias("_hi"))
    points = cut(ends.select(key, "_x", F.explode(F.array_distinct(F.array("_lo", "_hi"))).alias("_y")))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[["_x", "_y"]].to_numpy(float)
        none = pd.DataFrame({key: [pdf[key].iloc[0]], **{c: [None] for c in ("major", "minor", "angle", "cx", "cy")}})
        if len(p) < 3 or np.linalg.matrix_rank(p - p.mean(0), tol=1e-9 * max(1.0, np.abs(p - p.mean(0)).max())) < 2:
            return none
        q, u = np.column_stack([p, np.ones(len(p))]), np.full(len(p), 1 / len(p))
        for _ in range(rounds):
            far = np.einsum("ij,ij->i", q @ np.linalg.inv(q.T @ (q * u[:, None])), q)
            j = int(np.argmax(far))
            step = (far[j] - 3) / (3 * (far[j] - 1))
            moved = -step * u
            moved[j] += step
            u = u + moved
            if np.linalg.norm(moved) <= close:
                break
        center = u @ p
        size, turn = np.linalg.eigh(2 * ((p * u[:, None]).T @ p - np.outer(center, center)))
        angle = np.degrees(np.arctan2(turn[1, 1], turn[0, 1])) % 180
        return pd.DataFrame({key: [pdf[key].iloc[0]], "major": [np.sqrt(size[1])], "minor": [np.sqrt(max(size[0], 0.0))], "angle": [angle], "cx": [center[0]], "cy": [center[1]]})

    return points.groupBy(key).applyInPandas(fit, f"{key} {kind}, major double, minor double, angle double, cx double, cy double")
