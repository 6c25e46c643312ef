"""Incremental jobs: partial sums that later chunks add to, logs that are still written, restartable snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.logs import parse_log


def accumulate(spark: SparkSession, source: str, target: str, keys: list[str], value: str) -> DataFrame:
    """Reads a folder's new files as a stream and keeps one row of sums for each batch and key.

    A batch overwrites its own folder, so one that is run again after a failure does not count twice; readers add
    the batches up.
    """
    schema = spark.read.parquet(source).schema

    def add(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy(*keys).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
        sums.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(source)
    stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{target}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target).groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def deduplicated(spark: SparkSession, source: str, target: str, columns: dict[str, str], keys: list[str]) -> DataFrame:
    """Parses text logs as they grow and keeps the first row of each key, with the keys seen as state."""
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(source)
    rows = parse_log(lines, columns).dropDuplicates(keys)
    rows.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", f"{target}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target)


def overwrite_snapshots(df: DataFrame, path: str, snap: str) -> None:
    """Writes snapshots into their own folders; only those that occur are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(snap).parquet(path)
