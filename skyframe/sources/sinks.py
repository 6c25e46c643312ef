"""Writers: derived catalogs with metadata, cutouts, reduced copies; and the union of partial results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import scratch  # noqa: F401  (where writers put what is read back)


def write_catalog(df: DataFrame, path: str, attributes: dict) -> None:
    """A derived catalog: values by object, and a one-row table of attributes beside it."""
    df.write.mode("overwrite").parquet(f"{path}/values")
    df.sparkSession.createDataFrame([(json.dumps(attributes),)], "attributes string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def read_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/values"), json.loads(spark.read.json(f"{path}/meta").first()["attributes"])


def combine(parts: list[DataFrame], key: str) -> DataFrame:
    """The union of partial results; a key in two of them is an error."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    twice = F.count(F.lit(1)) > 1
    if out.groupBy(key).agg(twice.alias("twice")).where("twice").limit(1).count():
        raise ValueError(f"parts share values of {key}")
    return out


def write_cutouts(members: DataFrame, path: str, key: str) -> None:
    """A folder of members for each object."""
    members.repartition(key).write.mode("overwrite").partitionBy(key).parquet(path)


def rewrite(df: DataFrame, path: str, fields: list[str], files: int) -> None:
    """A copy with fewer fields in another number of files."""
    df.select(*fields).repartition(files).write.mode("overwrite").parquet(path)
