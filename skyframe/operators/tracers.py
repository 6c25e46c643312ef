"""Tracers and branches through time: parents of unknown type, modes of accretion, quantities at formation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import min_image


def typed_parents(rows: DataFrame, ids: DataFrame, kinds: list[str], snap: str, parent: str, keep: list[str], missing: str = "null") -> DataFrame:
    """Adds `kind` and the columns `keep` of each row's parent, whose type is not known.

    `ids` has (snap, kind, id, keep): the id tables of every snapshot and type.  Where an id is in several, the first
    of `kinds` counts, and within a type the row with the smallest `keep`; types not listed are not looked at.  The
    parents are settled before rows are joined, so each row meets one of them at most.  Without a parent the columns
    are null or, with missing="error", a row that has a parent id but no such parent is an error.
    """
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    first = ids.where(rank > 0).groupBy(F.col("snap").alias("_s"), F.col("id").alias("_i")).agg(F.min(F.struct(rank.alias("rank"), *keep)).alias("_p"))
    found = rows.join(first, (rows[snap] == first["_s"]) & (rows[parent] == first["_i"]), "left")
    if missing == "error":
        lost = found.where(F.col("_p").isNull() & F.col(parent).isNotNull()).count()
        if lost:
            raise ValueError(f"{lost} rows have a parent that is in no id table")
    kind = F.element_at(F.array(*map(F.lit, kinds)), F.col("_p.rank").cast("int"))
    return found.select(*rows.columns, F.when(F.col("_p").isNotNull(), kind).alias("kind"), *(F.col(f"_p.{c}").alias(c) for c in keep))


def branch_of_final(parents: DataFrame, halo_of: DataFrame, branch: DataFrame) -> DataFrame:
    """(tracer, snap, obj), (obj, halo, first_obj), (root, snap, obj) -> (tracer, root, snap, obj): the branch of the central of each tracer's last halo.

    Tracers that end in no object, or whose central has no branch, have one row with root and obj -1 and a null snap.
    """
    last = parents.groupBy("tracer").agg(F.max_by("obj", "snap").alias("_last"))
    central = last.join(halo_of.select(F.col("obj").alias("_last"), F.col("first_obj").alias("root")), "_last", "left").select("tracer", "root")
    out = central.join(branch, "root", "left")
    return out.select("tracer", F.when(F.col("obj").isNull(), -1).otherwise(F.col("root")).alias("root"), "snap", F.coalesce("obj", F.lit(-1)).alias("obj"))


def accretion_modes(parents: DataFrame, branch: DataFrame, entered: DataFrame) -> DataFrame:
    """(tracer, snap, obj; -1: in none), (tracer, snap, obj) of the branch each belongs to, (tracer, acc) -> (tracer, mode).

    none: never inside, or no branch at the snapshot of entry; smooth: entered at the first snapshot of all, or before
    and at entry only in the branch's own object or in none; merger: in another object (or none) at entry; stripped:
    in the branch's object at entry, but in another one, or in any while the branch is not there yet, before.
    """
    first = parents.agg(F.min("snap")).first()[0]
    on = branch.select("tracer", "snap", F.col("obj").alias("_main"))
    rows = entered.join(parents, "tracer", "left").join(on, ["tracer", "snap"], "left")
    at = lambda c: F.max(F.when(F.col("snap") == F.col("acc"), c))
    other = (F.col("snap") <= F.col("acc")) & (F.col("obj") != -1) & ~F.coalesce(F.col("obj") == F.col("_main"), F.lit(False))
    seen = rows.groupBy("tracer", "acc").agg(at(F.col("_main")).alias("_main"), at(F.col("obj")).alias("_obj"), F.bool_or(other).alias("_other"))
    mode = (
        F.when(F.col("acc").isNull(), "none").when(F.col("acc") == F.lit(first), "smooth").when(F.col("_main").isNull(), "none")
        .when(F.coalesce(F.col("_obj"), F.lit(-1)) != F.col("_main"), "merger").when(F.coalesce("_other", F.lit(False)), "stripped").otherwise("smooth"))
    return seen.select("tracer", mode.alias("mode"))


def at_formation(branch: DataFrame, halos: DataFrame, pos: list[str], box: float) -> DataFrame:
    """Quantities of each branch's earliest row, with the halo of its snapshot: root, snap, satellite, distance_rvir, dm_fraction.

    `branch`: (root, snap, sub, halo, positions, mass, dm); `halos`: (snap, halo, first_sub, positions, rvir).  The
    distance is 0 at the halo's center and infinite where the halo has no radius; all is null without the halo.
    """
    first = branch.groupBy("root").agg(F.min_by(F.struct(*(c for c in branch.columns if c != "root")), "snap").alias("_b")).select("root", "_b.*")
    halos = halos.select("snap", "halo", "first_sub", "rvir", *(F.col(p).alias(f"_h{p}") for p in pos))
    rows = first.join(halos, ["snap", "halo"], "left")
    gap = [min_image(F.col(p) - F.col(f"_h{p}"), box) for p in pos]
    d = F.sqrt(sum((g * g for g in gap[1:]), gap[0] * gap[0]))
    ratio: Column = F.when(d == 0, 0.0).when(F.col("rvir") == 0, float("inf")).otherwise(F.try_divide(d, F.col("rvir")))
    return rows.select("root", "snap", (F.col("first_sub") != F.col("sub")).cast("int").alias("satellite"), ratio.alias("distance_rvir"), F.try_divide("dm", "mass").alias("dm_fraction"))
