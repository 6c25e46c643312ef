"""Small helpers that the corpus operators share: staging, gapless numbering and joins that survive hot keys."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where that is unset, a local one in local mode only (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: a reliable checkpoint in the shared folder, which outlives any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Like cut(), as a Parquet table: for wide rows, of which later passes read a few columns."""
    df.write.parquet(path := new_dir(df.sparkSession, name))
    return df.sparkSession.read.parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_of(n: int, *cols) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def range_bounds(df: DataFrame, order: list[str], parts: int, rows: int, per_range: int = 40) -> list[tuple]:
    """At most parts - 1 values of `order` that occur in `df` and cut it into ranges of about equal size.

    They come from a sample of a bounded number of rows, and decide only where rows go.
    """
    drawn = df.select(*order).sample(min(1.0, per_range * parts / max(rows, 1)), seed=7).limit(2 * per_range * parts)
    sample = sorted(tuple(r) for r in drawn.collect())
    return sorted({sample[k * len(sample) // parts] for k in range(1, parts)}) if sample else []


class Ranges:
    """Bounds as a constant array, for rows with the columns `order` of the types `kinds`."""

    def __init__(self, bounds: list[tuple], order: list[Column], kinds: list[str]):
        names = [f"k{i}" for i in range(len(order))]
        self.n = len(bounds)
        self.array = F.from_json(F.lit(json.dumps([dict(zip(names, b)) for b in bounds])), f"array<struct<{','.join(f'{n}:{k}' for n, k in zip(names, kinds))}>>")
        self.key = F.struct(*(c.cast(k).alias(n) for c, n, k in zip(order, names, kinds)))

    def _at(self, k: Column) -> Column:
        return F.try_element_at(self.array, F.least(F.greatest(k, F.lit(1)), F.lit(max(1, self.n))))

    def index(self) -> Column:
        """How many of the bounds are at or before a row, by halving."""
        steps = F.array(*(F.lit(1 << k) for k in range(self.n.bit_length() - 1, -1, -1))).cast("array<int>")
        return F.aggregate(steps, F.lit(0), lambda low, step: F.when((low + step <= self.n) & (self._at(low + step) <= self.key), low + step).otherwise(low))

    def starts(self, index: Column) -> Column:
        """Whether a row of that index is the bound itself."""
        return F.coalesce((index > 0) & (self._at(index) == self.key), F.lit(False))


def gapless_rank(df: DataFrame, keys: list[str], order: list[str], rows: int, name: str, per_bucket: int = 20_000) -> DataFrame:
    """Adds `name`: a number from 0 without gaps within `keys`.

    Two levels: rows of a key are hashed by `order` into buckets; bucket counts give offsets, and only a bucket's
    rows are sorted together.  So a key that holds a third of all rows is still numbered by many tasks.
    `order` must tell rows apart for the numbers to be reproducible; rows equal in it get neighbouring numbers.
    """
    n = max(1, min(rows // per_bucket + 1, 1 << 20), min(4 * shuffle_partitions(df.sparkSession), rows // 50 + 1))
    df = df.withColumn("_nb", bucket_of(n, *order))
    sizes = df.groupBy(*keys, "_nb").agg(F.count(F.lit(1)).alias("_nc"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_nb").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_nb", F.coalesce(F.sum("_nc").over(before), F.lit(0)).alias("_no"))
    on = F.lit(True)
    left, right = df.alias("l"), sizes.alias("r")
    for k in [*keys, "_nb"]:
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    joined = left.join(right, on).select("l.*", "r._no")
    inner = Window.partitionBy(*keys, "_nb").orderBy(*order)
    return joined.withColumn(name, (F.row_number().over(inner) - 1 + F.col("_no")).cast("long")).drop("_nb", "_no")


def hot_lookup(left: DataFrame, right: DataFrame, key: str, rows: int, share: int = 1000) -> DataFrame:
    """left.join(right, key, 'left') for a `right` with one row for each key and `_n`, the key's number of left rows.

    Keys with more than rows/share rows of `left` number fewer than `share`, so they are broadcast whatever the
    size of the data; all other keys are shuffled and none of them is hot.  `_n` is left out of the result.
    """
    most = max(1, rows // share)
    hot = F.broadcast(right.where(F.col("_n") > most).drop("_n").withColumn("_hot", F.lit(True)))
    cold = right.where(F.col("_n") <= most).drop("_n")
    cols = [*left.columns, *(c for c in cold.columns if c != key)]
    found = left.join(hot, key, "inner").select(*cols)
    rest = left.join(hot.select(key), key, "left_anti").join(cold, key, "left").select(*cols)
    return found.unionByName(rest)


def connected(edges: DataFrame) -> DataFrame:
    """(a, b) pairs of longs -> (id, component): the smallest id that each id reaches.

    Smallest-label passes along the edges, each followed by a jump to the label's own label, until nothing
    changes.  Only aggregated rows meet at a label, and a label with many members is looked up by broadcast, of
    which there are under a thousand.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    state = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")))
    rows = state.count()
    while rows:
        near = both.join(state, both.b == state.id).groupBy("a").agg(F.min("component").alias("m"))
        step = cut(state.join(near, state.id == near.a).select("id", F.col("component").alias("was"), F.least("component", "m").alias("label")))
        roots = step.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
        target = step.select(F.col("id").alias("label"), F.col("label").alias("next"))
        target = cut(target.join(roots, "label").select("label", "next", "_n"))
        step = cut(hot_lookup(step, target, "label", rows).select("id", "was", F.least("label", F.coalesce("next", "label")).alias("component")))
        moved = step.where("was != component").limit(1).count()
        state = step.select("id", "component")
        if not moved:
            break
    return state
