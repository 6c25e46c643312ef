"""Particle and catalog loading: a field registry, derived types, chunked files, merged runs, foreign schemas."""

from __future__ import annotations

from collections.abc import Callable
from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import log_or_null, magnitude, restriction


class Fields:
    """Names to column builders: stored columns, aliases, registered fields, wildcards, and the suffix _log."""

    def __init__(self):
        self.builders: dict[str, Callable[[str], Column]] = {}
        self.meta: dict[str, dict] = {}

    def field(self, *names: str, **meta):
        def keep(f):
            for n in names:
                self.builders[n], self.meta[n] = f, meta
            return f

        return keep

    def column(self, df: DataFrame, name: str) -> Column:
        if name in df.columns:
            return F.col(name)
        if name in self.builders:
            return self.builders[name](name)
        if name.endswith("_log"):
            return log_or_null(self.column(df, name.removesuffix("_log")))
        for pattern, f in self.builders.items():
            if "*" in pattern and fnmatch(name, pattern):
                return f(name)
        raise KeyError(f"no field {name!r}")

    def load(self, df: DataFrame, names: list[str]) -> DataFrame:
        """Only the columns that these fields need are read."""
        return df.select(*(self.column(df, n).alias(n, metadata=self.meta.get(n, {})) for n in names))


FIELDS = Fields()


@FIELDS.field("weighted", "mass_value", label="mass times value")
def _weighted(name: str) -> Column:
    return F.round(F.col("mass") * F.col("value"), 2)


@FIELDS.field("speed", "vmag", label="speed", units="km/s")
def _speed(name: str) -> Column:
    return F.round(magnitude("vx", "vy", "vz"), 6)


@FIELDS.field("delta_*", label="offset from 500")
def _delta(name: str) -> Column:
    return F.col(name.removeprefix("delta_")) - 500


def derived_type(df: DataFrame, kinds: dict[str, dict], rest: str) -> DataFrame:
    """Adds kind: the first set of restrictions that a row meets."""
    out = F.lit(rest)
    for name, rules in reversed(kinds.items()):
        out = F.when(restriction(rules), F.lit(name)).otherwise(out)
    return df.withColumn("kind", out)


def chunk_offsets(df: DataFrame, chunk: str) -> DataFrame:
    """Rows of each chunk (file) and the global id of its first row; there are as many rows as chunks."""
    w = Window.orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    return df.groupBy(chunk).agg(F.count(F.lit(1)).alias("n")).withColumn("first_id", F.coalesce(F.sum("n").over(w), F.lit(0)))


def merged_runs(runs: list[tuple[int, DataFrame]], key: str, step: int) -> DataFrame:
    """Union of runs, each with its ids moved to a range of its own."""
    out = None
    for k, df in runs:
        one = df.withColumn(key, F.col(key) + F.lit(k * step)).withColumn("run", F.lit(k).cast("long"))
        out = one if out is None else out.unionByName(one)
    return out


def common_schema(df: DataFrame, mapping: dict[str, str], missing: dict) -> DataFrame:
    """A foreign table under our names: an expression for each column, a constant for what it lacks."""
    return df.select(*(F.expr(e).alias(n) for n, e in mapping.items()), *(F.lit(v).alias(n) for n, v in missing.items()))
