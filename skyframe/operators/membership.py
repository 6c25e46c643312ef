"""Rows and the objects that own them: offsets, owners of row indices, members of objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import prefix_sum


def offsets_from_lengths(objects: DataFrame, order: str, length: str, bucket: Column, keys: list[str] = (), name: str = "start") -> DataFrame:
    """Adds the exclusive running sum of lengths: where each object's rows start."""
    return prefix_sum(objects, F.col(length).cast("long"), [order], bucket, keys, name, inclusive=False)


def nested_offsets(parents: DataFrame, children: DataFrame, parent: str, child: str, start: str, length: str) -> DataFrame:
    """Adds child starts: the parent's start plus the lengths of earlier children; what is left at a parent's end is unowned."""
    w = Window.partitionBy(parent).orderBy(child).rowsBetween(Window.unboundedPreceding, -1)
    return children.join(parents.select(parent, F.col(start).alias("_p")), parent).withColumn("start", F.col("_p") + F.coalesce(F.sum(length).over(w), F.lit(0))).drop("_p")


def interval_lookup(points: DataFrame, intervals: DataFrame, x: str, start: str, length: str, give: list[str], width: int = 4096, how: str = "left") -> DataFrame:
    """Adds the columns `give` of the interval [start, start + length) that x lies in; intervals do not overlap.

    An equi-join on x div width: an interval is repeated for each step that it touches, which long intervals pay
    for and rows do not.
    """
    w = F.lit(width)
    cells = intervals.where(F.col(length) > 0).select(
        F.col(start).alias("_s"), (F.col(start) + F.col(length)).alias("_e"), *(F.col(c).alias(f"_give_{c}") for c in give),
        F.explode(F.sequence(F.floor(F.col(start) / w), F.floor((F.col(start) + F.col(length) - 1) / w))).alias("_to"),
    )
    probe = points.withColumn("_cell", F.floor(F.col(x) / w))
    hit = (F.col("_cell") == F.col("_to")) & (F.col(x) >= F.col("_s")) & (F.col(x) < F.col("_e"))
    return probe.join(cells, hit, how).select(*points.columns, *(F.col(f"_give_{c}").alias(c) for c in give))


def bounding_range(intervals: DataFrame, keys: list[str], start: str, length: str) -> DataFrame:
    """First and last (inclusive) row index of all objects together, for each of `keys`; empty objects do not count."""
    return intervals.where(F.col(length) > 0).groupBy(*keys).agg(F.min(start).alias("first_row"), F.max(F.col(start) + F.col(length) - 1).alias("last_row"))


def expand(objects: DataFrame, length: str, child: str = "child") -> DataFrame:
    """Each object once for each of its `length` children, numbered from 0."""
    return objects.where(F.col(length) > 0).withColumn(child, F.explode(F.sequence(F.lit(0).cast("long"), F.col(length).cast("long") - 1)))


def full_catalog(objects: DataFrame, catalog: DataFrame, key: str, fill: dict) -> DataFrame:
    """A partial catalog on all objects, with a fill value for each column that is missing."""
    return objects.select(key).join(catalog, key, "left").fillna(fill)


def central_flags(children: DataFrame, parents: DataFrame, child: str, parent: str, first: str, mass: str) -> DataFrame:
    """Adds is_central: the child is its parent's first, and the parent has mass."""
    p = parents.select(F.col(parent).alias("_p"), F.col(first).alias("_f"), F.col(mass).alias("_m"))
    return children.join(p, children[parent] == p["_p"], "left").withColumn("is_central", F.coalesce((F.col(child) == F.col("_f")) & (F.col("_m") > 0), F.lit(False))).drop("_p", "_f", "_m")
