"""Reductions of member rows per object: apertures, enclosed radii, kinematics, shapes, overdensities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sizes import running_sums


def weighted_mean(v, w) -> Column:
    """sum(w v) / sum(w); the plain mean if all weights are zero; null without rows."""
    total = F.sum(w)
    return F.when(total != 0, F.sum(v * w) / total).otherwise(F.avg(v))


def weighted_std(v, w) -> Column:
    """Population standard deviation under weights."""
    total = F.sum(w)
    mean = F.sum(v * w) / total
    return F.sqrt(F.greatest(F.sum(w * v * v) / total - mean * mean, F.lit(0.0)))


def reliability_std(v, w) -> Column:
    """Standard deviation with reliability weights; null with fewer than two weighted rows or without spread."""
    total, squares = F.sum(w), F.sum(w * w)
    n = F.sum(F.when(w != 0, 1).otherwise(0))
    spread = F.sum(w * v * v) - F.sum(w * v) * F.sum(w * v) / total
    return F.when((n > 1) & (spread > 0), F.sqrt(spread / (total - squares / total)))


def aperture(members: DataFrame, objects: DataFrame, key: str, distance2: Column, limits: tuple[Column, Column], aggs: dict[str, Column], fill: dict | None = None) -> DataFrame:
    """Member rows with limits[0] <= r^2 <= limits[1], reduced for each object; objects without rows get `fill`."""
    rows = members.withColumn("_r2", distance2).where((F.col("_r2") >= limits[0]) & (F.col("_r2") <= limits[1]))
    out = objects.select(key).join(rows.groupBy(key).agg(*(c.alias(k) for k, c in aggs.items())), key, "left")
    return out.fillna(fill) if fill else out


def enclosing_radii(rows: DataFrame, key: str, r: str, w: str, fractions: dict[str, float], tie: list[str], small: int = 1_000_000) -> DataFrame:
    """Radii that hold fractions of an object's weight: running sums in order of r, linear between rows, from 0 before the first.

    All fractions come from one order of the rows; the rows before and after each are found by partial aggregation.
    """
    rows = running_sums(rows.select(*dict.fromkeys([key, r, w, *tie])), key, r, tie, {"_c": w}, small, {"_t": "_c"})
    row = F.struct(F.col(r).alias("r"), *(F.col(c).alias(f"_{k}") for k, c in enumerate(tie)), F.col("_c").alias("c"))
    sums = []
    for n, f in fractions.items():
        reached = F.col("_c") >= F.col("_t") * f
        sums += [F.max(F.when(~reached, row)).alias(f"_a_{n}"), F.min(F.when(reached, row)).alias(f"_b_{n}")]
    found = rows.groupBy(key, "_t").agg(*sums)
    out = {}
    for n, f in fractions.items():
        pr, pc = (F.coalesce(F.col(f"_a_{n}.{x}"), F.lit(0.0)) for x in "rc")
        out[n] = pr + (F.col("_t") * f - pc) / (F.col(f"_b_{n}.c") - pc) * (F.col(f"_b_{n}.r") - pr)
    return found.where("_t > 0").select(key, *(v.alias(n) for n, v in out.items()))


def ordered_value(rows: DataFrame, key: str, by: str, tie: list[str], index: int, name: str, small: int = 1_000_000) -> DataFrame:
    """The element at `index` (from 0) in order, or the last one."""
    ranked = running_sums(rows.select(*dict.fromkeys([key, by, *tie])), key, by, tie, {"_k": F.lit(1)}, small)
    row = F.struct(by, *tie)
    best = ranked.groupBy(key).agg(F.max(F.when(F.col("_k") <= index + 1, row)).alias("_b"))
    return best.select(key, F.col(f"_b.{by}").alias(name))


def overdensity(rows: DataFrame, key: str, r: str, mass: str, tie: list[str], deltas: list[float], density: float, small: int = 1_000_000) -> DataFrame:
    """For each multiple of a density, the last radius within which the mean density is above it, and the mass there."""
    import math

    c = running_sums(rows.where(F.col(r) > 0), key, r, tie, {"_m": mass}, small).withColumn("_rho", F.col("_m") / (F.pow(F.col(r), F.lit(3.0)) * (4 / 3 * math.pi)))
    out = []
    for d in deltas:
        above = F.when(F.col("_rho") > d * density, F.struct(F.col(r).alias("r"), F.col("_m").alias("m")))
        out += [F.max(above)["r"].alias(f"r{d:g}"), F.max(above)["m"].alias(f"m{d:g}")]
    return c.groupBy(key).agg(*out)


def inertia(rows: DataFrame, key: str, pos: list[str], mass: str) -> DataFrame:
    """Six components of the moment of inertia about the origin."""
    x, y, z, m = (*(F.col(p) for p in pos), F.col(mass))
    parts = {"ixx": y * y + z * z, "iyy": x * x + z * z, "izz": x * x + y * y, "ixy": -x * y, "ixz": -x * z, "iyz": -y * z}
    return rows.groupBy(key).agg(*(F.sum(m * v).alias(k) for k, v in parts.items()))
