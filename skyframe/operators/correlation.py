"""Errors of pair statistics: replicates by subtraction, covariance, and a table of pair counts that splits are added to.

Nothing is counted again for a replicate.  Pairs are counted once by the tags (cubes or splits) of both sides, and
leaving a tag out subtracts what touches it; those tables have a row for each two tags and bin, however many pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import cut
from .spatial import pair_counts


def shells(edges: list[float]) -> Column:
    """The volumes between neighbouring edges, as an array."""
    return F.array(*(F.lit(4 / 3 * math.pi * (hi**3 - lo**3)) for lo, hi in zip(edges, edges[1:])))


def covariance(full: DataFrame, replicates: DataFrame, value: str, n: int, bins: int, about: str = "full") -> DataFrame:
    """(bin, value) and (replica, bin, value) -> (bin_a, bin_b, covar) of n leave-one-out replicates.

    (n - 1) / n times the sum of the products of deviations, over the number of bins.  Deviations are from the full
    sample's values or, with about="mean", from the replicates' means.
    """
    center = full if about == "full" else replicates.groupBy("bin").agg(F.avg(value).alias(value))
    off = replicates.join(center.select("bin", F.col(value).alias("_full")), "bin").select("replica", "bin", (F.col(value) - F.col("_full")).alias("_d"))
    a, b = (off.select("replica", F.col("bin").alias(f"bin_{x}"), F.col("_d").alias(f"_{x}")) for x in "ab")
    return a.join(b, "replica").groupBy("bin_a", "bin_b").agg((F.sum(F.col("_a") * F.col("_b")) * ((n - 1) / n / bins)).alias("covar"))


def errors(covar: DataFrame, name: str) -> DataFrame:
    """(bin, name): the square roots of the diagonal."""
    return covar.where("bin_a = bin_b").select(F.col("bin_a").alias("bin"), F.sqrt("covar").alias(name))


def cube_of(dims: list[str], box: float, side: int) -> Column:
    """The cube of a position among side^3, each open below and closed above; -1 on the lower faces of the box, which are in none."""
    at = [(F.ceil(F.col(d) * side / F.lit(float(box))) - 1).cast("int") for d in dims]
    number = at[0]
    for k in at[1:]:
        number = number * side + k
    return F.when(F.least(*at) < 0, F.lit(-1)).otherwise(number)


def left_out(dd: DataFrame, tags: list[int], values: list[str]) -> DataFrame:
    """(bin, tag_a, tag_b, values) -> (replica, bin, values): the totals without what touches a tag, for every tag."""
    totals = dd.groupBy("bin").agg(*(F.sum(v).alias(f"_{v}") for v in values)).withColumn("replica", F.explode(F.array(*map(F.lit, tags))))
    touched = dd.withColumn("replica", F.explode(F.array_distinct(F.array("tag_a", "tag_b")))).groupBy("replica", "bin").agg(*(F.sum(v).alias(v) for v in values))
    return totals.join(touched, ["replica", "bin"], "left").select("replica", "bin", *((F.col(f"_{v}") - F.coalesce(v, F.lit(0.0))).alias(v) for v in values))


def jackknife(points: DataFrame, key: str, dims: list[str], box: float, edges: list[float], side: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Autocorrelation with errors from side^3 samples that leave one cube out.

    Returns (bin, dd, xi, xi_err), (replica, bin, xi) and (bin_a, bin_b, covar).  A sample's expectation is that of its
    own number of points in the whole box.  Bins without pairs have no row.
    """
    tags, volume = list(range(side**3)), box**3
    points = points.select(key, *dims, cube_of(dims, box, side).alias("_cube"))
    dd = cut(pair_counts(points, points, key, key, dims, box, edges, auto=True, tags=("_cube", "_cube")))
    sizes = {r["_cube"]: r["n"] for r in points.groupBy("_cube").agg(F.count(F.lit(1)).alias("n")).collect()}  # side^3 + 1 rows
    n = sum(sizes.values())
    xi = lambda count: F.col("dd") / (shells(edges)[F.col("bin")] * count * count / volume) - 1
    full = dd.groupBy("bin").agg(F.sum("dd").alias("dd")).withColumn("xi", xi(F.lit(float(n))))
    kept = F.array(*(F.lit(float(n - sizes.get(k, 0))) for k in tags))
    samples = left_out(dd, tags, ["dd"]).select("replica", "bin", xi(kept[F.col("replica")]).alias("xi"))
    covar = cut(covariance(full, samples, "xi", len(tags), len(edges) - 1))
    return full.join(errors(covar, "xi_err"), "bin"), samples, covar


class PairTable:
    """Weighted pair counts of all points with those of a split, one folder a split, and the correlation of the splits that exist.

    A split that is added again replaces its own folder only, so a job that failed can be run again.  Each split's rows
    are (split, tag_a, bin, dd, rr): pairs with each split of the first side, and the expected ones.
    """

    def __init__(self, spark: SparkSession, path: str, box: float, edges: list[float]):
        self.spark, self.path, self.box, self.edges = spark, path, float(box), edges

    def add(self, points: DataFrame, splits: list[int], key: str, dims: list[str], split: str, weight: str | None = None) -> None:
        """Counts pairs of all points with those whose `split` is listed.  Weights under 0 count as 0; a weight that is not finite is an error."""
        w = F.greatest(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
        points = points.select(key, *dims, F.col(split).cast("int").alias("_split"), w.alias("_w"))
        sums = points.groupBy("_split").agg(F.count(F.lit(1)).alias("n"), F.sum("_w").alias("w")).collect()  # one row a split
        n, total = sum(r["n"] for r in sums), sum(r["w"] or 0.0 for r in sums)
        if not math.isfinite(total):
            raise ValueError("weights must be finite")
        sizes = {r["_split"]: r["n"] for r in sums}
        mean = total / n if n else 1.0
        some = points.where(F.col("_split").isin(splits))
        dd = pair_counts(points, some, key, key, dims, self.box, self.edges, auto=False, weight="_w", tags=("_split", "_split"), skip_self=True)
        rows = [(b, a, k, 4 / 3 * math.pi * (hi**3 - lo**3) / self.box**3 * mean * mean * sizes[a] * sizes.get(b, 0)) for b in splits for a in sizes for k, (lo, hi) in enumerate(zip(self.edges, self.edges[1:]))]
        expected = self.spark.createDataFrame(rows, "split int, tag_a int, bin int, rr double")
        dd = dd.select(F.col("tag_b").alias("split"), "tag_a", "bin", "dd")
        table = expected.join(dd, ["split", "tag_a", "bin"], "left").fillna(0.0, ["dd"])
        table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split").parquet(self.path)

    def combined(self) -> tuple[DataFrame, DataFrame]:
        """(bin, splits, xi, xi_err) and (bin_a, bin_b, covar) of the splits that exist; replicates leave one split of the second side out."""
        table = cut(self.spark.read.parquet(self.path).groupBy("split", "bin").agg(F.sum("dd").alias("dd"), F.sum("rr").alias("rr")))
        splits = sorted(r["split"] for r in table.select("split").distinct().collect())
        by_split = table.select("bin", F.col("split").alias("tag_a"), F.col("split").alias("tag_b"), "dd", "rr")
        xi = (F.col("dd") / F.col("rr") - 1).alias("xi")
        full = table.groupBy("bin").agg(F.sum("dd").alias("dd"), F.sum("rr").alias("rr")).select("bin", xi)
        samples = left_out(by_split, splits, ["dd", "rr"]).where("rr > 0").select("replica", "bin", xi)
        covar = cut(covariance(full, samples, "xi", len(splits), len(self.edges) - 1))
        return full.join(errors(covar, "xi_err"), "bin", "left").withColumn("splits", F.lit(len(splits))), covar


def conformity(counts: DataFrame, side: int, bins: int) -> DataFrame:
    """Shares of flagged neighbours around primaries, with errors from samples that leave one cube out of both sides.

    `counts`: (center, m, cube_a, cube_b, bin, r, n): m primaries that have the same n neighbours, r of them flagged, in
    a bin and cube; one row for each of these, cubes as of cube_of().  Returns (bin, mean_share, mean_err, stacked,
    stacked_err): the mean over the primaries that have neighbours in a bin, and the share of all neighbours together.
    A sample changes only primaries within the cube (gone) or with a neighbour in it, so corrections to the totals are
    added up by cube.
    """
    part = cut(counts)
    whole = part.groupBy("center", "cube_a", "bin").agg(F.first("m").alias("m"), F.sum("r").alias("hits"), F.sum("n").alias("all"))
    total = lambda x, name: F.sum(F.col("m") * x).alias(name)
    totals = whole.groupBy("bin").agg(total(F.col("hits") / F.col("all"), "shares"), F.sum("m").alias("primaries"), total(F.col("hits"), "hits"), total(F.col("all"), "all"))
    gone = whole.select("bin", "m", F.col("cube_a").alias("replica"), (-F.col("hits") / F.col("all")).alias("s"), F.lit(-1).alias("c"), (-F.col("hits")).alias("r"), (-F.col("all")).alias("n"))
    rest = F.col("all") - F.col("n")
    less = part.join(whole.drop("m"), ["center", "cube_a", "bin"]).where("cube_b <> cube_a").select(
        "bin", "m", F.col("cube_b").alias("replica"), (F.when(rest > 0, (F.col("hits") - F.col("r")) / rest).otherwise(0.0) - F.col("hits") / F.col("all")).alias("s"), F.when(rest > 0, 0).otherwise(-1).alias("c"), (-F.col("r")).alias("r"), (-F.col("n")).alias("n"))
    off = gone.unionByName(less).groupBy("replica", "bin").agg(*(total(F.col(x), x) for x in "scrn"))
    share = lambda a, b: F.try_divide(a, b)
    full = cut(totals.select("bin", share(F.col("shares"), F.col("primaries")).alias("mean_share"), share(F.col("hits"), F.col("all")).alias("stacked")))
    grid = totals.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(side**3 - 1)))).join(off, ["replica", "bin"], "left").fillna(0, ["s", "c", "r", "n"])
    samples = cut(grid.select("replica", "bin", share(F.col("shares") + F.col("s"), F.col("primaries") + F.col("c")).alias("mean_share"), share(F.col("hits") + F.col("r"), F.col("all") + F.col("n")).alias("stacked")))
    for value, name in (("mean_share", "mean_err"), ("stacked", "stacked_err")):
        full = full.join(errors(covariance(full, samples.where(F.col(value).isNotNull()), value, side**3, bins), name), "bin")
    return full
