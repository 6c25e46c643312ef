"""Segmentation: connected components of cells past a threshold, and the properties of the pieces."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import separation
from .lineage import cut


def components(nodes: DataFrame, edges: DataFrame, node: str = "id", a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest id that a node reaches by edges between given nodes.

    Smallest labels pass along edges and then jump to their label's label, until nothing changes; each round is a
    reliable checkpoint.
    """
    known = nodes.select(F.col(node).alias("n")).distinct()
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b).alias("u"), F.col(a).alias("v")))
    both = cut(both.join(known.withColumnRenamed("n", "u"), "u", "left_semi").join(known.withColumnRenamed("n", "v"), "v", "left_semi"))
    state = cut(known.select("n", F.col("n").alias("label")))
    rows = state.count()
    while True:
        near = both.join(state.select(F.col("n").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("m"))
        step = cut(state.join(near, state.n == near.u, "left").select("n", F.col("label").alias("was"), F.least("label", "m").alias("label")))
        step = cut(_jumped(step, rows))
        moved = step.where("was <> label").limit(1).count()
        state = step.select("n", "label")
        if not moved:
            return state.withColumnRenamed("n", node)


def _jumped(step: DataFrame, rows: int, share: int = 1000) -> DataFrame:
    """Every label's own label.  Labels with over rows/share members, fewer than `share`, are looked up by broadcast."""
    sizes = step.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    jump = cut(step.select(F.col("n").alias("label"), F.col("label").alias("next")).join(sizes, "label"))
    most = max(1, rows // share)
    hot, cold = F.broadcast(jump.where(F.col("_n") > most).select("label", "next")), jump.where(F.col("_n") <= most).select("label", "next")
    both = step.join(hot, "label").unionByName(step.join(hot.select("label"), "label", "left_anti").join(cold, "label"))
    return both.select("n", "was", F.least("label", "next").alias("label"))


def clump_properties(cells: DataFrame, label: str, value: str, pos: list[str], volumes: DataFrame, center: list[float], box: float) -> DataFrame:
    """For each label: total, mean, least and median value, rows, weighted center c<axis>, the radius of a sphere of its `volume`, and its periodic distance from `center`."""
    v = F.col(value)
    stats = [F.sum(v).alias("total"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.percentile(v, F.lit(0.5)).alias("mid"), F.count(F.lit(1)).alias("rows")]
    props = cells.groupBy(label).agg(*stats, *((F.sum(v * F.col(p)) / F.sum(v)).alias(f"c{p}") for p in pos)).join(volumes, label)
    distance = separation([f"c{p}" for p in pos], [F.lit(c) for c in center], box)
    return props.withColumns({"radius": F.pow(F.col("volume") * 3 / (4 * math.pi), F.lit(1 / 3)), "distance": distance})


def dense_labels(labels: DataFrame, label: str = "label") -> DataFrame:
    """Labels numbered from 0 in order of size (largest first, then smaller label)."""
    from pyspark.sql import Window

    sizes = labels.groupBy(label).agg(F.count(F.lit(1)).alias("cells"))
    return sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cells"), label)) - 1)
