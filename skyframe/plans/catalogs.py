"""Named derived catalogs: a table of definitions, built together where they share a scan."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import restriction
from ..operators.reduce import weighted_mean, weighted_std


def aperture_rule(rule: str) -> Column:
    """A rule's squared radius: a number, "<factor> <column>", or "min(<number>, <factor> <column>)"."""
    if m := re.fullmatch(r"min\(([\d.]+), ([\d.]+) (\w+)\)", rule):
        return F.pow(F.least(F.lit(float(m[1])), F.col(m[3]) * float(m[2])), F.lit(2.0))
    if m := re.fullmatch(r"([\d.]+) (\w+)", rule):
        return F.pow(F.col(m[2]) * float(m[1]), F.lit(2.0))
    return F.lit(float(rule) ** 2)


@dataclass(frozen=True)
class Definition:
    """One value for each object: op over `value` of one kind of rows within an aperture."""

    op: str
    value: str
    kind: str | None = None
    weight: str | None = None
    aperture: str | None = None
    rules: dict = field(default_factory=dict)

    def column(self, kind: str, r2: str) -> Column:
        keep = F.lit(True) & restriction(self.rules)
        if self.kind:
            keep = keep & (F.col(kind) == self.kind)
        if self.aperture:
            keep = keep & (F.col(r2) <= aperture_rule(self.aperture))
        v = F.when(keep, F.col(self.value))
        w = F.when(keep, F.col(self.weight) if self.weight else F.lit(1.0))
        if self.op == "sum":
            return F.coalesce(F.sum(v), F.lit(0.0))
        return {"mean": lambda: weighted_mean(v, w), "std": lambda: weighted_std(v, w), "max": lambda: F.max(v), "min": lambda: F.min(v), "count": lambda: F.count(v)}[self.op]()


@dataclass(frozen=True)
class Reducer:
    """A user's reduction: of a pandas frame with all rows of an object, or of the numbers that parts of it were reduced to."""

    whole: Callable | None = None
    part: Callable | None = None
    finish: Callable | None = None


REDUCERS: dict[str, Reducer] = {}


def reducer(name: str, finish: Callable | None = None):
    """Registers a user's reduction.

    Without `finish`, a function of a pandas frame of one object's rows that returns one number.  With it, a function
    of a frame with some of an object's rows that returns a list of numbers; `finish` gets an array with such a list in
    each row, in no certain order, and returns the number.
    """

    def keep(f):
        REDUCERS[name] = Reducer(part=f, finish=finish) if finish else Reducer(whole=f)
        return f

    return keep


def build(rows: DataFrame, objects: DataFrame, key: str, catalogs: dict[str, Definition], kind: str, r2: str) -> DataFrame:
    """All catalogs of one scan: one shuffle of partial results however many there are."""
    got = rows.groupBy(key).agg(*(d.column(kind, r2).alias(n) for n, d in catalogs.items()))
    zero = {n: 0.0 for n, d in catalogs.items() if d.op in ("sum", "count")}
    return objects.select(key).join(got, key, "left").fillna(zero)


def reduce_custom(rows: DataFrame, key: str, name: str, most: int = 1_000_000) -> DataFrame:
    """A registered reduction for each object, in pandas: for statistics that have no aggregate form.

    A reduction in parts gets at most about `most` rows at a time however many an object has, and its parts are put
    together by object.  One of whole objects needs all of an object's rows in one task: an object with more than
    `most` rows is an error that asks for parts, before any row is moved.
    """
    import numpy as np
    import pandas as pd

    f, kind = REDUCERS[name], rows.schema[key].dataType.simpleString()

    def one(pdf):
        return pd.DataFrame({key: [pdf[key].iloc[0]], name: [float(f.whole(pdf))]})

    def part(pdf):
        return pd.DataFrame({key: [pdf[key].iloc[0]], "_part": [[float(v) for v in f.part(pdf.drop(columns="_slice"))]]})

    def finish(pdf):
        return pd.DataFrame({key: [pdf[key].iloc[0]], name: [float(f.finish(np.stack(pdf["_part"].to_list())))]})

    large = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    if f.whole:
        if not large.isEmpty():
            raise ValueError(f"{name}: an object has over {most} rows; register it in parts")
        return rows.groupBy(key).applyInPandas(one, f"{key} {kind}, {name} double")
    slices = F.ceil(F.coalesce("_n", F.lit(1)) / most)
    rows = rows.join(large, key, "left").withColumn("_slice", F.pmod(F.xxhash64(*rows.columns, F.monotonically_increasing_id()), slices)).drop("_n")
    parts = rows.groupBy(key, "_slice").applyInPandas(part, f"{key} {kind}, _part array<double>")
    return parts.groupBy(key).applyInPandas(finish, f"{key} {kind}, {name} double")
