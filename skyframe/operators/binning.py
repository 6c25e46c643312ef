"""Histograms, binned statistics and running relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def median(x) -> Column:
    return F.percentile(x, F.lit(0.5))


def histogram(df: DataFrame, bins: dict[str, Column], weight: Column | None = None) -> DataFrame:
    """Counts and weights by one or more bin columns; rows outside of any are left out."""
    rows = df.withColumns(bins).dropna(subset=list(bins))
    return rows.groupBy(*bins).agg(F.count(F.lit(1)).alias("n"), F.sum(weight if weight is not None else F.lit(1.0)).alias("w"))


def column_share(hist: DataFrame, column: str, value: str = "w") -> DataFrame:
    """Adds value / the column's largest value: a conditional histogram."""
    return hist.withColumn("share", F.col(value) / F.max(value).over(Window.partitionBy(column)))


def adaptive_edges(df: DataFrame, x: str, bins: int, least: int = 10) -> list[float]:
    """Starts of `bins` equal bins from min to max, of which one with fewer than `least` rows joins the next one.

    The last of the starts opens a bin without end; it needs half as many rows, else it joins the one before
    (rather than being dropped, so that every row counts).
    Only the counts of the equal bins come to the driver.
    """
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    if lo is None or hi == lo or bins < 2:
        return [] if lo is None else [lo]
    step = (hi - lo) / (bins - 1)
    k = F.least(F.floor((F.col(x) - lo) / step), F.lit(bins - 1)).cast("int")
    counts = {r["k"]: r["n"] for r in df.where(F.col(x).isNotNull()).groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    edges, held, full = [], 0, True
    for b in range(bins):
        if full:
            edges.append(lo + b * step)
            held = 0
        held += counts.get(b, 0)
        full = held >= least
    if held < least / 2 and len(edges) > 1:
        edges.pop()
    return edges


def running(df: DataFrame, x: str, y: str, edges: list[float], percentiles: list[float] = ()) -> DataFrame:
    """Median, mean and deviation of y in bins from each edge to the next (the last without end); x is the median x."""
    k = F.lit(None).cast("int")
    for i, e in enumerate(edges):
        k = F.when(F.col(x) >= e, F.lit(i)).otherwise(k)
    rows = df.withColumn("bin", k).where("bin is not null")
    extra = [F.percentile(y, F.lit(p / 100)).alias(f"p{p:g}") for p in percentiles]
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), median(x).alias("x_mid"), median(y).alias("y_mid"), F.avg(y).alias("y_mean"), F.stddev_pop(y).alias("y_std"), *extra)


def clipped(df: DataFrame, bin_col: str, y: str, low: float, high: float) -> DataFrame:
    """Rows whose y lies within its bin's percentiles [low, high]."""
    limits = df.groupBy(bin_col).agg(F.percentile(y, F.lit(low / 100)).alias("_lo"), F.percentile(y, F.lit(high / 100)).alias("_hi"))
    return df.join(limits, bin_col).where(F.col(y).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def sample_per_bin(df: DataFrame, bin_col: str, k: int, key: str, seed: int = 7919) -> DataFrame:
    """At most k rows of each bin, in an order that whole-number arithmetic on the key shuffles."""
    w = Window.partitionBy(bin_col).orderBy(F.pmod(F.col(key) * seed, F.lit(1_000_003)), key)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")
