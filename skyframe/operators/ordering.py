"""Global order without a global sort: row numbers and running sums over a whole table in two levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _joined(df: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(sums, [*keys, "_b"], "inner")


def prefix_sum(df: DataFrame, value: str | Column, order: list, bucket: Column, keys: list[str] = (), name: str = "total", inclusive: bool = True) -> DataFrame:
    """Adds the running sum of `value` in `order` within `keys`.

    `bucket` must not decrease along the order (a coarse step of its first column): bucket totals are summed first,
    then each bucket is ordered by itself, so one key with most of the rows is still the work of many tasks.
    """
    keys = list(keys)
    df = df.withColumn("_v", F.col(value) if isinstance(value, str) else value).withColumn("_b", bucket)
    last = -1
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, last)
    sums = df.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s")).withColumn("_o", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    inner = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return _joined(df, sums, keys).withColumn(name, F.col("_o") + F.coalesce(F.sum("_v").over(inner), F.lit(0))).drop("_v", "_b", "_o")


def row_index(df: DataFrame, order: list, bucket: Column, keys: list[str] = (), name: str = "row_index") -> DataFrame:
    """Adds a number from 0 in `order` (which must tell rows apart), as prefix_sum() of ones."""
    return prefix_sum(df, F.lit(1).cast("long"), order, bucket, keys, name, inclusive=False).withColumn(name, F.col(name).cast("long"))


def nth_rows(df: DataFrame, index: str, positions: list[int]) -> DataFrame:
    """Rows at given positions, in their order; a position that repeats gives its row again."""
    wanted = df.sparkSession.createDataFrame([(p, int(i)) for p, i in enumerate(positions)], f"pos int, {index} long")
    return df.join(F.broadcast(wanted), index).orderBy("pos")  # the positions are a literal list


def even_sample(df: DataFrame, index: str, rows: int, count: int, log: bool = False) -> DataFrame:
    """`count` rows at evenly spaced positions from 0 to the last (or logarithmically from 1 on), rounded down.

    A position that repeats gives its row again; with no more rows than `count` all of them come, once.
    """
    if count >= rows:
        return df
    if log:
        at = [rows - 1 if k == count - 1 else int((rows - 1) ** (k / (count - 1))) for k in range(count)]
    else:
        at = [k * (rows - 1) // max(1, count - 1) for k in range(count)]
    wanted = df.sparkSession.createDataFrame([(i,) for i in at], f"{index} long")
    return df.join(F.broadcast(wanted), index)  # `count` rows, a parameter


def islands(df: DataFrame, keys: list[str], x: str, least: int = 2) -> DataFrame:
    """Runs of consecutive whole numbers: first, end (exclusive) and length of each run of at least `least`."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(x)
    marked = df.select(*keys, x).distinct().withColumn("_g", F.col(x) - F.row_number().over(w))
    runs = marked.groupBy(*keys, "_g").agg(F.min(x).alias("first"), (F.max(x) + 1).alias("end"), F.count(F.lit(1)).alias("length"))
    return runs.where(F.col("length") >= least).drop("_g")
