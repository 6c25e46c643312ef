"""White-space separated text logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def parse_log(lines: DataFrame, columns: dict[str, str], text: str = "value") -> DataFrame:
    """Typed columns of all lines with the right number of words whose numbers parse; other lines are left out."""
    words = F.split(F.trim(F.col(text)), r"\s+")
    rows = lines.select(words.alias("_w")).where(F.size("_w") == len(columns))
    rows = rows.select(*(F.col("_w")[i].try_cast(kind).alias(name) for i, (name, kind) in enumerate(columns.items())))
    return rows.dropna(subset=[n for n, kind in columns.items() if kind != "string"])


def read_log(spark, path: str, columns: dict[str, str]) -> DataFrame:
    return parse_log(spark.read.text(path), columns)


def first_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order: logs that a restarted run wrote twice."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
