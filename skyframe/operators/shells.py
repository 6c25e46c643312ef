"""Samples on spheres: directions of equal area, and radii at which samples pass a threshold."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .binning import median


def directions(spark: SparkSession, side: int) -> DataFrame:
    """(ray, x, y, z): 12 side^2 unit vectors at the middles of cells of equal area, in rings from pole to pole."""
    out, n = [], side
    for i in range(1, 4 * n):
        if i < n or i > 3 * n:  # the caps: 4 i cells in the ring i from the pole
            k = i if i < n else 4 * n - i
            z, count, shift = 1 - k * k / (3 * n * n), 4 * k, 0.5
            z = z if i < n else -z
        else:
            z, count, shift = 4 / 3 - 2 * i / (3 * n), 4 * n, ((i - n + 1) % 2) / 2
        for j in range(1, count + 1):
            phi, flat = 2 * math.pi / count * (j - shift), math.sqrt(1 - z * z)
            out.append((len(out), flat * math.cos(phi), flat * math.sin(phi), z))
    return spark.createDataFrame(out, "ray int, x double, y double, z double")


def radial_gradient(samples: DataFrame, keys: list[str], k: str, value: str, step: Column | float) -> DataFrame:
    """Replaces `value` by its derivative along each ray: central differences, one-sided at the ends."""
    w = Window.partitionBy(*keys).orderBy(k)
    ahead, behind = F.lead(value).over(w), F.lag(value).over(w)
    first, last = F.row_number().over(w) == 1, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(k))) == 1
    step = step if isinstance(step, Column) else F.lit(float(step))
    slope = F.when(first, (ahead - F.col(value)) / step).when(last, (F.col(value) - behind) / step).otherwise((ahead - behind) / (2 * step))
    return samples.withColumn("_g", slope).withColumn(value, F.col("_g")).drop("_g")


def threshold_radii(samples: DataFrame, obj: str, ray: str, k: str, value: str, low: float, step: float, bins: int, percent: float, rule: str, least: float = 0.5, window: float = 0.5, combine: int = 4) -> DataFrame:
    """Radii of each object at which its samples pass a percentile of theirs: near_peak, all_mid, near_ray_peak, ray_near_peak, ray_mid.

    Sample k of a ray is at radius low + k step.  Samples within `least`, of value 0 and without value do not count.
    Those above (rule ">") or below ("<") the percentile vote: a histogram over `combine` radial steps has a peak (the
    first of equal ones), and so has one of each ray's outermost vote.  The radii are medians: of the votes within
    `window` of the peak's inner edge, of all, of those near the rays' peak, of the rays' outermost near it, and of all
    the rays' outermost.  Null where nothing votes.
    """
    if rule not in ("<", ">"):
        raise ValueError("rule is < or >")
    edges = (bins + combine - 1) // combine  # every `combine`th radius; the last bin has both its edges
    r = F.lit(low) + F.col("_k") * F.lit(step)
    rows = samples.select(F.col(obj).alias("_o"), F.col(ray).alias("_ray"), F.col(k).alias("_k"), F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias("_q"))
    rows = rows.withColumn("_r", r).where(F.col("_q").isNotNull() & (F.col("_q") != 0) & (F.col("_r") >= least))
    limit = rows.groupBy("_o").agg(F.percentile("_q", F.lit(percent / 100)).alias("_t"))
    votes = rows.join(limit, "_o").where(F.col("_q") > F.col("_t") if rule == ">" else F.col("_q") < F.col("_t")).select("_o", "_ray", "_k", "_r")
    outer = votes.groupBy("_o", "_ray").agg(F.max("_k").alias("_k")).withColumn("_r", r)

    def peak(df: DataFrame, name: str) -> DataFrame:
        at = F.when(F.col("_k") <= combine * (edges - 1), F.least(F.floor(F.col("_k") / combine), F.lit(max(edges - 2, 0))))
        counts = df.groupBy("_o", at.alias("_b")).agg(F.count("_k").alias("_n")).withColumn("_n", F.when(F.col("_b").isNull(), 0).otherwise(F.col("_n")))
        best = counts.groupBy("_o").agg(F.max(F.struct("_n", (-F.coalesce("_b", F.lit(0))).alias("_b")))["_b"].alias("_m"))
        return best.select("_o", (F.lit(low) - F.col("_m") * combine * F.lit(step)).alias(name))

    near = lambda c: (F.col("_r") > F.col(c) - window) & (F.col("_r") <= F.col(c) + window)
    peaks = peak(votes, "_p").join(peak(outer, "_pr"), "_o")
    of_votes = votes.join(peaks, "_o").groupBy("_o").agg(median(F.when(near("_p"), F.col("_r"))).alias("near_peak"), median("_r").alias("all_mid"), median(F.when(near("_pr"), F.col("_r"))).alias("near_ray_peak"))
    of_rays = outer.join(peaks, "_o").groupBy("_o").agg(median(F.when(near("_pr"), F.col("_r"))).alias("ray_near_peak"), median("_r").alias("ray_mid"))
    objects = samples.select(F.col(obj).alias("_o")).distinct()
    return objects.join(of_votes, "_o", "left").join(of_rays, "_o", "left").withColumnRenamed("_o", obj)
