"""Tracks through time: branches, crossings, extrema, gaps, smoothing."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def track(key: str, order: str) -> Window:
    return Window.partitionBy(key).orderBy(order)


def first_inside(df: DataFrame, key: str, order: str, time: str, r: str, limit: float, name: str) -> DataFrame:
    """Time at which each track first has r below a limit, linear in r since the row before.

    A null r is outside; a track that is inside from its first row on has that row's time; one that never is, null.
    """
    w = track(key, order)
    rows = df.withColumn("_in", F.coalesce(F.col(r) < limit, F.lit(False))).withColumns({"_pr": F.lag(r).over(w), "_pt": F.lag(time).over(w)})
    at = F.when(F.col("_pr").isNull(), F.col(time)).otherwise(F.col("_pt") + (F.col("_pr") - limit) / (F.col("_pr") - F.col(r)) * (F.col(time) - F.col("_pt")))
    return rows.groupBy(key).agg(F.min_by(F.when(F.col("_in"), at), F.when(F.col("_in"), F.col(order))).alias(name))


def extremum(df: DataFrame, key: str, order: str, value: str, most: bool = True, mask: Column | None = None) -> DataFrame:
    """Largest (or smallest) value of each track and the first time it is reached, of unmasked rows."""
    v = F.when(~mask, F.col(value)) if mask is not None else F.col(value)
    best = F.max(F.struct(v.alias("v"), (-F.col(order)).alias("o"))) if most else F.min(F.struct(v.alias("v"), F.col(order).alias("o")))
    out = df.where(v.isNotNull()).groupBy(key).agg(best.alias("_b"))
    return out.select(key, F.col("_b.v").alias("value"), F.abs("_b.o").alias("at"))


def branches(tree: DataFrame, roots: DataFrame, node: str, last: str, root: str, width: int = 4096) -> DataFrame:
    """Rows of each root's branch in a depth-first numbered tree: node between the root's number and its last one.

    An equi-join on node div width, as intervals of different roots may overlap only along one path.
    """
    spans = roots.select(F.col(node).alias("_a"), F.col(last).alias("_z"), F.col(root).alias("root"), F.explode(F.sequence(F.floor(F.col(node) / width), F.floor(F.col(last) / width))).alias("_cell"))
    rows = tree.withColumn("_cell", F.floor(F.col(node) / width))
    return rows.join(spans, "_cell").where((F.col(node) >= F.col("_a")) & (F.col(node) <= F.col("_z"))).drop("_cell", "_a", "_z")


def fill_gaps(df: DataFrame, key: str, t: str, values: list[str], only_single: bool = False) -> DataFrame:
    """Rows for missing whole times between a track's rows, linear between its neighbours; `ghost` marks them."""
    w = track(key, t)
    nxt = df.withColumns({"_t": F.lead(t).over(w), **{f"_{v}": F.lead(v).over(w) for v in values}})
    gap = F.col("_t") - F.col(t)
    steps = F.when((gap == 2) if only_single else (gap > 1), F.sequence(F.lit(0), (gap - 1).cast("int"))).otherwise(F.array(F.lit(0)))
    rows = nxt.withColumn("_s", F.explode(steps))
    at = F.col("_s") / gap
    cols = [F.when(F.col("_s") == 0, F.col(v)).otherwise(F.col(v) + (F.col(f"_{v}") - F.col(v)) * at).alias(v) for v in values]
    return rows.select(key, (F.col(t) + F.col("_s")).alias(t), *cols, (F.col("_s") > 0).alias("ghost"))


def moving(df: DataFrame, key: str, t: str, value: str, half: int, name: str, kind: str = "mean") -> DataFrame:
    """Centered moving mean (ends unchanged) or median (missing neighbours count as zero) over 2 half + 1 rows."""
    w = track(key, t)
    wide = w.rowsBetween(-half, half)
    if kind == "mean":
        inside = (F.row_number().over(w) > half) & (F.count(F.lit(1)).over(Window.partitionBy(key)) - F.row_number().over(w) >= half)
        return df.withColumn(name, F.when(inside, F.avg(value).over(wide)).otherwise(F.col(value)))
    got = F.collect_list(value).over(wide)
    padded = F.sort_array(F.concat(got, F.array_repeat(F.lit(0.0), F.lit(2 * half + 1) - F.size(got))))
    return df.withColumn("_g", padded).withColumn(name, F.element_at("_g", half + 1)).drop("_g")


def without_outliers(df: DataFrame, key: str, t: str, value: str, sigmas: float, name: str) -> DataFrame:
    """Values whose step differs from the track's mean step by many deviations become the mean of their neighbours."""
    w = track(key, t)
    rows = df.withColumn("_d", F.col(value) - F.lag(value).over(w))
    all_ = Window.partitionBy(key)
    odd = F.abs(F.col("_d") - F.avg("_d").over(all_)) > sigmas * F.stddev_pop("_d").over(all_)
    mean = (F.lag(value).over(w) + F.lead(value).over(w)) / 2
    return rows.withColumn(name, F.when(odd & mean.isNotNull(), mean).otherwise(F.col(value))).drop("_d")


def polynomial(df: DataFrame, key: str, t: str, value: str, order: int, name: str) -> DataFrame:
    """Adds each track's least-squares polynomial of that order at its own times.

    The normal equations come from sums of powers, of times moved and scaled to -1..1 for each track, so no track is
    gathered.  A track with fewer different times than coefficients has the polynomial of least norm.
    """
    import numpy as np
    import pandas as pd

    kind, n = df.schema[key].dataType.simpleString(), order + 1
    span = df.groupBy(key).agg(((F.max(t) + F.min(t)) / 2).alias("_mid"), F.greatest((F.max(t) - F.min(t)) / 2, F.lit(1e-300)).alias("_half"))
    rows = df.join(span, key).withColumn("_u", (F.col(t) - F.col("_mid")) / F.col("_half"))
    sums = rows.where(F.col(value).isNotNull()).groupBy(key).agg(
        *(F.sum(F.pow("_u", F.lit(float(k)))).alias(f"s{k}") for k in range(2 * n - 1)), *(F.sum(F.pow("_u", F.lit(float(k))) * F.col(value)).alias(f"v{k}") for k in range(n)))

    def solve(batches):
        for pdf in batches:
            s, v = pdf[[f"s{k}" for k in range(2 * n - 1)]].to_numpy(float), pdf[[f"v{k}" for k in range(n)]].to_numpy(float)
            m = s[:, np.arange(n)[:, None] + np.arange(n)[None]] if len(pdf) else np.zeros((0, n, n))
            c = (np.linalg.pinv(m, hermitian=True, rcond=1e-12) @ v[:, :, None])[:, :, 0] if len(pdf) else np.zeros((0, n))
            yield pd.DataFrame({key: pdf[key], "_c": list(c)})

    found = sums.mapInPandas(solve, f"{key} {kind}, _c array<double>")
    at = F.aggregate(F.reverse("_c"), F.lit(0.0), lambda total, c: total * F.col("_u") + c)
    return rows.join(found, key, "left").withColumn(name, at).select(*df.columns, name)


def evened_steps(df: DataFrame, key: str, order: str, scale: str, share: float = 0.8) -> DataFrame:
    """The rows of each track that are left when runs of small steps are thinned to every second row.

    A step is the change of log10 of `scale` since the row before (the first row has the second one's).  In each run
    of two or more rows, one after another, whose step is below `share` of the track's median, the first, third, ... goes.
    """
    w = track(key, order)
    rows = df.withColumn("_l", F.log10(scale)).withColumns({"_k": F.row_number().over(w), "_step": F.col("_l") - F.lag("_l").over(w)})
    rows = rows.withColumn("_step", F.coalesce("_step", F.lead("_step").over(w)))
    mid = rows.groupBy(key).agg(F.percentile("_step", F.lit(0.5)).alias("_mid"))
    small = F.coalesce(F.col("_step") < share * F.col("_mid"), F.lit(False))
    rows = rows.join(mid, key).withColumn("_small", small)
    of_kind = Window.partitionBy(key, "_small").orderBy(order)
    rows = rows.withColumn("_run", F.col("_k") - F.row_number().over(of_kind))
    run = Window.partitionBy(key, "_small", "_run")
    rows = rows.withColumns({"_place": F.row_number().over(run.orderBy(order)), "_size": F.count(F.lit(1)).over(run)})
    return rows.where(~F.col("_small") | (F.col("_size") == 1) | (F.col("_place") % 2 == 0)).select(*df.columns)


def stays_above(df: DataFrame, key: str, t: str, value: str, low: tuple[float, float], high: tuple[float, float]) -> DataFrame:
    """Events of tracks against two moving boundaries, each (level at 0, slope): key, event, n, start, stop.

    "below": from the first row until the track first leaves the region under the lower boundary, if it begins there;
    "above": each stay at or over the upper one, numbered from 1.  Between rows a track is a straight line, so times
    of crossing are exact; a stay that begins with the track starts at its first row, and one that lasts has no stop.
    Where times are whole numbers, boundaries at the rows are decimals, so a value written like one is on it.
    """
    at = lambda b, x: b[0] + b[1] * x
    whole = df.schema[t].dataType.typeName() in ("byte", "short", "integer", "long")
    level = lambda b: at([F.lit(Decimal(str(v))) for v in b] if whole else b, F.col(t))
    rows = df.select(key, F.col(t).cast("double").alias("_t"), F.col(value).alias("_v"), (F.col(value) >= level(high)).alias("_above"), (F.col(value) < level(low)).alias("_below"))
    w = track(key, "_t")
    rows = rows.withColumns({"_pt": F.lag("_t").over(w), "_pv": F.lag("_v").over(w)})
    cross = lambda b: F.col("_pt") + (at(b, F.col("_pt")) - F.col("_pv")) / ((F.col("_v") - F.col("_pv")) / (F.col("_t") - F.col("_pt")) - b[1])
    rows = rows.withColumn("_was", F.lag("_above").over(w))
    rows = rows.withColumn("_n", F.sum((F.col("_above") & ~F.coalesce("_was", F.lit(False))).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    enters, leaves = F.col("_above") & ~F.coalesce("_was", F.lit(False)), ~F.col("_above") & F.coalesce("_was", F.lit(False))
    above = rows.where(enters | leaves).groupBy(key, F.col("_n").alias("n")).agg(
        F.max(F.when(enters, F.coalesce(cross(high), F.col("_t")))).alias("start"), F.max(F.when(leaves, cross(high))).alias("stop")).withColumn("event", F.lit("above"))
    out = F.when(~F.col("_below"), F.coalesce(cross(low), F.col("_t")))
    begins = rows.groupBy(key).agg(F.min("_t").alias("start"), F.min_by("_below", "_t").alias("_b"), F.min_by(out, F.when(~F.col("_below"), F.col("_t"))).alias("stop")).where("_b")
    begins = begins.select(key, F.lit("below").alias("event"), F.lit(1).cast("long").alias("n"), "start", "stop")
    return begins.unionByName(above.select(key, "event", "n", "start", "stop"))
