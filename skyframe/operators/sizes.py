"""Objects apart by their number of rows: small ones fit a task, large ones are the work of many."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .ordering import prefix_sum


def sender(keys: DataFrame, most: int = 100_000) -> Callable[[DataFrame], DataFrame]:
    """F.broadcast for tables with a row for each key, or for fewer of them, if there are at most `most`; else tables stay as they are."""
    return F.broadcast if keys.limit(most + 1).count() <= most else lambda df: df


def by_size(rows: DataFrame, key: str, small: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of objects with up to `small` rows, and those of the others (None if there are none)."""
    large = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > small).select(key))
    if large.isEmpty():
        return rows, None
    send = sender(large)
    return rows.join(send(large), key, "left_anti"), rows.join(send(large), key, "left_semi")


def running_sums(rows: DataFrame, key: str, by: str, tie: list[str], sums: dict[str, str | Column], small: int = 1_000_000, lasts: dict[str, str] | None = None) -> DataFrame:
    """Adds running sums (the own row included) in the order of `by` and `tie` within each object, and the `lasts` {name: sum} of some.

    An object of up to `small` rows is ordered in one task.  A larger one is cut into steps of `by`, whose totals are
    added up first, so no task orders more than a few steps of it.
    """
    few, many = by_size(rows, key, small)
    upto = Window.partitionBy(key).orderBy(by, *tie).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key).orderBy(by, *tie).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lasts = lasts or {}
    out = few.withColumns({n: F.sum(c).over(upto) for n, c in sums.items()})
    out = out.withColumns({n: F.last(c).over(whole) for n, c in lasts.items()})
    if many is None:
        return out
    span = many.groupBy(key).agg(F.min(by).alias("_lo"), F.max(by).alias("_hi"), F.ceil(F.count(F.lit(1)) * 8 / F.lit(max(small, 1))).alias("_parts"))
    many = many.join(sender(span)(span), key)
    step = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col(by) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_parts"))).otherwise(F.lit(0))
    for n, c in sums.items():
        many = prefix_sum(many, c, [by, *tie], step, [key], n)
    if lasts:
        ends = many.groupBy(key).agg(*(F.max_by(c, F.struct(by, *tie, c)).alias(n) for n, c in lasts.items()))
        many = many.join(sender(span)(ends), key)
    return out.unionByName(many.drop("_lo", "_hi", "_parts"))
