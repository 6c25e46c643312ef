"""Tracks, branches and window functions; sorts and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import matching as M
from ..operators import tracers as T
from ..operators.ordering import even_sample, islands, prefix_sum, row_index
from ..plans.roles import query



def track():
    return Window.partitionBy("tracer_id").orderBy("snap")


def whole():
    return Window.partitionBy("tracer_id")


R6 = lambda c: F.round(c, 6)


@query("j20_tracers_through_time", "SELECT user_id AS tracer_id, event_id, s_acctbal, CAST(coalesce(n_regionkey, -1) AS INTEGER) AS region FROM events LEFT JOIN supplier ON user_id = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey")
def j20(t):
    rows = t.events.select(F.col("user_id").alias("tracer_id"), "event_id").join(t.supplier, F.col("tracer_id") == F.col("s_suppkey"), "left")
    return M.lookup(rows, t.nation.withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey", "n_regionkey", "region").select("tracer_id", "event_id", "s_acctbal", F.col("region").cast("int").alias("region"))


@query("j21_branch_of_final_halo", "SELECT row_index, coalesce(first_sub, -1) AS central FROM particles LEFT JOIN halos USING (halo_id) WHERE pt = 'R'")
def j21(t):
    return M.lookup(t.particles.where("pt = 'R'"), t.halos, "halo_id", "first_sub", "central").select("row_index", "central")


@query("j22_main_branches", "SELECT t.sub_id AS node, r.sub_id AS root FROM subs t JOIN (SELECT sub_id, sub_id + halo_id % 40 AS last FROM subs) r ON t.sub_id BETWEEN r.sub_id AND r.last")
def j22(t):
    tree = t.subs.select(F.col("sub_id").alias("node"))
    roots = t.subs.select(F.col("sub_id").alias("node"), F.expr("sub_id + halo_id % 40").alias("last"), F.col("sub_id").alias("root_id"))
    return H.branches(tree, roots, "node", "last", "root_id", width=64).select("node", "root")  # branches are shorter than a cell


@query("j23_descendants", "SELECT a.sub_id, b.sub_id AS descendant, b.mass FROM subs a JOIN subs b ON b.sub_id = a.sub_id - 1 - a.halo_id % 7")
def j23(t):
    next_ = t.subs.select(F.col("sub_id").alias("descendant"), "mass")
    return t.subs.select("sub_id", F.expr("sub_id - 1 - halo_id % 7").alias("descendant")).join(next_, "descendant").select("sub_id", "descendant", "mass")


@query("j35_value_at_time", "SELECT tracer_id, value FROM tracks WHERE snap = (SELECT max_by(snap, (-abs(redshift - 1.04), snap)) FROM snapshots)")
def j35(t):
    one = t.spark.createDataFrame([(1.04,)], "z double")
    at = M.nearest_time(one, t.snapshots, "z", "redshift", "snap", "snap").select(F.col("snap").cast("int").alias("snap"))
    return t.tracks.join(at, "snap").select("tracer_id", "value")


@query("j36_branch_in_box", "SELECT tracer_id, bool_or(r < 0.4) AS inside, round(min(abs(r - 0.4)), 6) AS edge, count(*) AS n FROM tracks GROUP BY 1 HAVING count(*) > 3")
def j36(t):
    return t.tracks.groupBy("tracer_id").agg(F.bool_or(F.col("r") < 0.4).alias("inside"), R6(F.min(F.abs(F.col("r") - 0.4))).alias("edge"), F.count(F.lit(1)).alias("n")).where("n > 3")


@query("j37_box_track_range", "SELECT tracer_id, min(snap) AS first, max(snap) AS last FROM tracks WHERE r < 0.4 AND tracer_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 3000) GROUP BY 1")
def j37(t):
    picked = t.supplier.where("s_acctbal > 3000").select(F.col("s_suppkey").alias("tracer_id"))
    return t.tracks.where("r < 0.4").join(picked, "tracer_id", "left_semi").groupBy("tracer_id").agg(F.min("snap").alias("first"), F.max("snap").alias("last"))


@query("a64_branch_statistics", "SELECT tracer_id, min(value) AS lo, max(value) AS hi, round(avg(value), 8) AS mean, round(stddev_pop(value), 6) AS std, round(sum(value), 2) AS total FROM tracks GROUP BY 1")
def a64(t):
    v = F.col("value")
    return t.tracks.groupBy("tracer_id").agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.round(F.avg(v), 8).alias("mean"), R6(F.stddev_pop(v)).alias("std"), F.round(F.sum(v), 2).alias("total"))


@query("a65_formation_time", """WITH m AS (SELECT tracer_id, snap, max(value) OVER (PARTITION BY tracer_id ORDER BY snap) AS m, max(value) OVER (PARTITION BY tracer_id) AS top FROM tracks),
    p AS (SELECT *, lag(m) OVER (PARTITION BY tracer_id ORDER BY snap) AS pm, lag(snap) OVER (PARTITION BY tracer_id ORDER BY snap) AS ps FROM m)
    SELECT tracer_id, round(min(CASE WHEN pm IS NULL THEN snap ELSE ps + (top / 2 - pm) / (m - pm) * (snap - ps) END), 6) AS formed FROM p WHERE m >= top / 2 AND (pm IS NULL OR pm < top / 2) GROUP BY 1""")
def a65(t):
    m = t.tracks.withColumns({"m": F.max("value").over(track()), "top": F.max("value").over(whole())})
    p = m.withColumns({"pm": F.lag("m").over(track()), "ps": F.lag("snap").over(track())})
    half = F.col("top") / 2
    at = F.when(F.col("pm").isNull(), F.col("snap").cast("double")).otherwise(F.col("ps") + (half - F.col("pm")) / (F.col("m") - F.col("pm")) * (F.col("snap") - F.col("ps")))
    return p.where((F.col("m") >= half) & (F.col("pm").isNull() | (F.col("pm") < half))).groupBy("tracer_id").agg(R6(F.min(at)).alias("formed"))


@query("a66_at_formation", "SELECT tracer_id, min_by(value, snap) AS value, min_by(kind, snap) AS kind, min(snap) AS snap FROM tracks GROUP BY 1")
def a66(t):
    return t.tracks.groupBy("tracer_id").agg(F.min_by("value", "snap").alias("value"), F.min_by("kind", "snap").alias("kind"), F.min("snap").alias("snap"))


@query("a67_at_largest", "SELECT tracer_id, max_by(r, (value, -snap)) AS r FROM tracks GROUP BY 1")
def a67(t):
    return t.tracks.groupBy("tracer_id").agg(F.max_by("r", F.struct("value", -F.col("snap"))).alias("r"))


_ACC = """(WITH p AS (SELECT *, lag(r) OVER (PARTITION BY tracer_id ORDER BY snap) AS pr, lag(snap) OVER (PARTITION BY tracer_id ORDER BY snap) AS ps FROM tracks)
    SELECT tracer_id, min_by(CASE WHEN pr IS NULL THEN snap ELSE ps + (pr - 0.5) / (pr - r) * (snap - ps) END, snap) FILTER (r < 0.5) AS acc FROM p GROUP BY 1)"""


@query("a68_accretion_time", f"SELECT tracer_id, round(acc, 6) AS acc FROM {_ACC}")
def a68(t):
    return H.first_inside(t.tracks.withColumn("time", F.col("snap").cast("double")), "tracer_id", "snap", "time", "r", 0.5, "acc").withColumn("acc", R6("acc"))


_MODE = f"""(SELECT tracer_id, CASE WHEN acc IS NULL THEN 'none' WHEN bool_and(kind = 'click') FILTER (snap < acc) IS NULL THEN 'smooth' WHEN bool_and(kind <> 'click') FILTER (snap < acc) THEN 'merger' ELSE 'stripped' END AS mode FROM tracks JOIN {_ACC} USING (tracer_id) GROUP BY tracer_id, acc)"""


@query("a69_accretion_mode", f"SELECT tracer_id, mode FROM {_MODE}")
def a69(t):
    return accretion_mode(t)


def accretion_mode(t):
    acc = H.first_inside(t.tracks.withColumn("time", F.col("snap").cast("double")), "tracer_id", "snap", "time", "r", 0.5, "acc")
    before = F.when(F.col("snap") < F.col("acc"), F.col("kind") != "click")
    rows = t.tracks.join(acc, "tracer_id").groupBy("tracer_id", "acc").agg(F.bool_and(before).alias("other"))
    mode = F.when(F.col("acc").isNull(), "none").when(F.col("other").isNull(), "smooth").when(F.col("other"), "merger").otherwise("stripped")
    return rows.select("tracer_id", mode.alias("mode"))


@query("a70_track_extremum", "SELECT tracer_id, max(value) AS value, min_by(snap, (-value, snap)) AS at FROM tracks WHERE kind <> 'error' GROUP BY 1")
def a70(t):
    return H.extremum(t.tracks, "tracer_id", "snap", "value", mask=F.col("kind") == "error")


@query("a71_means_by_type_and_mode", f"SELECT tracer_id % 10 AS obj, coalesce(kind, 'all') AS kind, coalesce(mode, 'all') AS mode, round(avg(value), 6) AS mean, count(*) AS n FROM tracks JOIN {_MODE} USING (tracer_id) GROUP BY tracer_id % 10, CUBE (kind, mode)")
def a71(t):
    rows = t.tracks.join(accretion_mode(t), "tracer_id").withColumn("obj", F.expr("tracer_id % 10"))
    # Margins from partial sums: the rows are read and shuffled once.
    sums = rows.groupBy("obj", "kind", "mode").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    cube = sums.cube("obj", "kind", "mode").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).where("obj is not null")
    return cube.select("obj", F.coalesce("kind", F.lit("all")).alias("kind"), F.coalesce("mode", F.lit("all")).alias("mode"), R6(F.col("s") / F.col("n")).alias("mean"), "n")


@query("a97_attribute_tracks", "SELECT s.s_suppkey AS root, p.snap, coalesce(t.value, -1) AS value FROM supplier s CROSS JOIN snapshots p LEFT JOIN tracks t ON t.tracer_id = s.s_suppkey AND t.snap = p.snap")
def a97(t):
    snaps = F.explode(F.sequence(F.lit(0), F.lit(29)))
    want = t.supplier.select(F.col("s_suppkey").alias("tracer_id"), snaps.alias("snap"))
    out = want.join(t.tracks.select("tracer_id", "snap", "value"), ["tracer_id", "snap"], "left")
    return out.select(F.col("tracer_id").alias("root"), "snap", F.coalesce("value", F.lit(-1.0)).alias("value"))


@query("a98_boundary_crossings", """WITH s AS (SELECT tracer_id, snap, r, CASE WHEN r < 0.6 + snap * 0.01 THEN 0 WHEN r < 1.0 + snap * 0.01 THEN 1 ELSE 2 END AS state FROM tracks),
    p AS (SELECT *, lag(state) OVER (PARTITION BY tracer_id ORDER BY snap) AS ps, lag(r) OVER (PARTITION BY tracer_id ORDER BY snap) AS pr, lag(snap) OVER (PARTITION BY tracer_id ORDER BY snap) AS pt FROM s)
    SELECT tracer_id, count(*) FILTER (ps = 0 AND state > 0) AS exits, count(*) FILTER (ps < 2 AND state = 2) AS entries, count(*) FILTER (ps = 2 AND state < 2) AS leaves,
    round(min_by(pt + (1.0 + pt * 0.01 - pr) / ((r - pr) / (snap - pt) - 0.01), snap) FILTER (ps < 2 AND state = 2), 6) AS first_entry FROM p GROUP BY 1""")
def a98(t):
    low, high = F.expr("0.6 + snap * 0.01"), F.expr("1.0 + snap * 0.01")  # decimals: 1.14 at snapshot 14, which no double sum gives
    s = t.tracks.withColumn("state", F.when(F.col("r") < low, 0).when(F.col("r") < high, 1).otherwise(2))
    p = s.withColumns({"ps": F.lag("state").over(track()), "pr": F.lag("r").over(track()), "pt": F.lag("snap").over(track())})
    at = F.col("pt") + (F.expr("1.0 + pt * 0.01") - F.col("pr")) / ((F.col("r") - F.col("pr")) / (F.col("snap") - F.col("pt")) - 0.01)
    enters = (F.col("ps") < 2) & (F.col("state") == 2)
    return p.groupBy("tracer_id").agg(F.count_if((F.col("ps") == 0) & (F.col("state") > 0)).alias("exits"), F.count_if(enters).alias("entries"), F.count_if((F.col("ps") == 2) & (F.col("state") < 2)).alias("leaves"), R6(F.min_by(F.when(enters, at), F.when(enters, F.col("snap")))).alias("first_entry"))


@query("a99_displacements", "SELECT CAST(floor(b.r / 0.25) AS INTEGER) AS ix, CAST(floor(b.value / 50) AS INTEGER) AS iy, round(median(a.r), 6) AS r0, round(median(a.value), 6) AS v0, count(*) AS n FROM tracks a JOIN tracks b USING (tracer_id) WHERE a.snap = 5 AND b.snap = 20 GROUP BY ALL")
def a99(t):
    a = t.tracks.where("snap = 5").select("tracer_id", F.col("r").alias("ra"), F.col("value").alias("va"))
    rows = t.tracks.where("snap = 20").join(a, "tracer_id")
    mid = lambda c: R6(F.percentile(c, F.lit(0.5)))
    return rows.groupBy(F.floor(F.col("r") / 0.25).cast("int").alias("ix"), F.floor(F.col("value") / 50).cast("int").alias("iy")).agg(mid("ra").alias("r0"), mid("va").alias("v0"), F.count(F.lit(1)).alias("n"))


@query("a103_clump_history", "SELECT tracer_id % 12 AS clump, snap, round(avg(value), 8) AS mean, round(median(r), 8) AS half_size, count(*) AS n, round(avg(CASE WHEN kind = 'click' THEN 1.0 ELSE 0 END), 6) AS clicks FROM tracks GROUP BY ALL")
def a103(t):
    rows = t.tracks.groupBy(F.expr("tracer_id % 12").alias("clump"), "snap")
    return rows.agg(F.round(F.avg("value"), 8).alias("mean"), F.round(F.percentile("r", F.lit(0.5)), 8).alias("half_size"), F.count(F.lit(1)).alias("n"), R6(F.avg(F.when(F.col("kind") == "click", 1.0).otherwise(0.0))).alias("clicks"))


@query("a82_apertures_through_time", "SELECT tracer_id % 12 AS obj, snap, a AS aperture, round(sum(value) FILTER (r <= a), 2) AS total, max(value) FILTER (r <= a) AS top FROM tracks, (VALUES (0.5), (1.0), (2.0)) v(a) GROUP BY ALL")
def a82(t):
    rows = t.tracks.withColumn("aperture", F.explode(F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0))))
    v = F.when(F.col("r") <= F.col("aperture"), F.col("value"))
    return rows.groupBy(F.expr("tracer_id % 12").alias("obj"), "snap", "aperture").agg(F.round(F.sum(v), 2).alias("total"), F.max(v).alias("top"))


@query("w1_cumulative_sum", "SELECT row_index, sum(mass) OVER (ORDER BY row_index) AS total FROM particles")
def w1(t):
    return prefix_sum(t.particles, "mass", ["row_index"], F.floor(F.col("row_index") / 4096)).select("row_index", "total")


@query("w2_moving_average", "SELECT tracer_id, snap, round(CASE WHEN row_number() OVER w > 2 AND count(*) OVER (PARTITION BY tracer_id) - row_number() OVER w >= 2 THEN avg(value) OVER (PARTITION BY tracer_id ORDER BY snap ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) ELSE value END, 6) AS smooth FROM tracks WINDOW w AS (PARTITION BY tracer_id ORDER BY snap)")
def w2(t):
    return H.moving(t.tracks, "tracer_id", "snap", "value", 2, "smooth").select("tracer_id", "snap", R6("smooth").alias("smooth"))


@query("w3_moving_median", "SELECT tracer_id, snap, list_sort(list_concat(list(value) OVER w, list_resize([0.0, 0.0, 0.0, 0.0, 0.0], 5 - CAST(count(*) OVER w AS INTEGER))))[3] AS smooth FROM tracks WINDOW w AS (PARTITION BY tracer_id ORDER BY snap ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def w3(t):
    return H.moving(t.tracks, "tracer_id", "snap", "value", 2, "smooth", "median").select("tracer_id", "snap", "smooth")


@query("w4_polynomial_smooth", "SELECT tracer_id, round(regr_slope(value, snap), 6) AS slope, round(regr_intercept(value, snap), 6) AS level FROM tracks GROUP BY 1")
def w4(t):
    """First order by normal equations: sums for each branch."""
    return t.tracks.groupBy("tracer_id").agg(R6(F.regr_slope("value", "snap")).alias("slope"), R6(F.regr_intercept("value", "snap")).alias("level"))


@query("w5_sliding_deviation", "SELECT tracer_id, snap, round(stddev_pop(value) OVER (PARTITION BY tracer_id ORDER BY snap ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING), 6) AS std FROM tracks")
def w5(t):
    return t.tracks.select("tracer_id", "snap", R6(F.stddev_pop("value").over(track().rowsBetween(-3, 2))).alias("std"))


@query("w6_ghost_rows", "WITH n AS (SELECT tracer_id, snap, value, lead(snap) OVER w AS ns, lead(value) OVER w AS nv FROM tracks WINDOW w AS (PARTITION BY tracer_id ORDER BY snap)) SELECT tracer_id, snap, value, false AS ghost FROM n UNION ALL SELECT tracer_id, snap + 1, value + (nv - value) * 0.5, true FROM n WHERE ns = snap + 2")
def w6(t):
    return H.fill_gaps(t.tracks.select("tracer_id", "snap", "value"), "tracer_id", "snap", ["value"], only_single=True)


@query("w7_complete_track", "WITH n AS (SELECT tracer_id, snap, r, lead(snap) OVER w AS ns, lead(r) OVER w AS nr FROM tracks WINDOW w AS (PARTITION BY tracer_id ORDER BY snap)) SELECT tracer_id, CAST(snap + k AS INTEGER) AS snap, round(r + coalesce((nr - r) * (k / (ns - snap)), 0), 9) AS r, k > 0 AS ghost FROM (SELECT *, unnest(range(coalesce(ns - snap, 1))) AS k FROM n)")
def w7(t):
    return H.fill_gaps(t.tracks.select("tracer_id", "snap", "r"), "tracer_id", "snap", ["r"]).withColumn("r", F.round("r", 9))


@query("w8_outlier_replacement", """WITH d AS (SELECT tracer_id, snap, value, value - lag(value) OVER w AS d, (lag(value) OVER w + lead(value) OVER w) / 2 AS m FROM tracks WINDOW w AS (PARTITION BY tracer_id ORDER BY snap))
    SELECT tracer_id, snap, round(CASE WHEN abs(d - avg(d) OVER (PARTITION BY tracer_id)) > 1.5 * stddev_pop(d) OVER (PARTITION BY tracer_id) AND m IS NOT NULL THEN m ELSE value END, 6) AS clean FROM d""")
def w8(t):
    return H.without_outliers(t.tracks, "tracer_id", "snap", "value", 1.5, "clean").select("tracer_id", "snap", R6("clean").alias("clean"))


@query("w9_running_max", "SELECT tracer_id, snap, max(value) OVER (PARTITION BY tracer_id ORDER BY snap) AS top FROM tracks")
def w9(t):
    return t.tracks.select("tracer_id", "snap", F.max("value").over(track()).alias("top"))


@query("w10_fill_single", "SELECT tracer_id, snap, round(CASE WHEN value < 20 THEN (lag(value) OVER w + lead(value) OVER w) / 2 ELSE value END, 6) AS filled FROM tracks WINDOW w AS (PARTITION BY tracer_id ORDER BY snap)")
def w10(t):
    return t.tracks.select("tracer_id", "snap", R6(F.when(F.col("value") < 20, (F.lag("value").over(track()) + F.lead("value").over(track())) / 2).otherwise(F.col("value"))).alias("filled"))


@query("w11_back_fill", "SELECT tracer_id, snap, first_value(CASE WHEN kind = 'click' THEN n END IGNORE NULLS) OVER (PARTITION BY tracer_id ORDER BY snap ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM tracks")
def w11(t):
    kept = F.when(F.col("kind") == "click", F.col("n"))
    return t.tracks.select("tracer_id", "snap", F.first(kept, ignorenulls=True).over(track().rowsBetween(0, Window.unboundedFollowing)).alias("n"))


@query("w12_islands", "SELECT tracer_id, min(snap) AS first, max(snap) + 1 AS end, count(*) AS length FROM (SELECT tracer_id, snap, snap - row_number() OVER (PARTITION BY tracer_id ORDER BY snap) AS g FROM tracks WHERE r < 1.2) GROUP BY tracer_id, g HAVING count(*) >= 2")
def w12(t):
    return islands(t.tracks.where("r < 1.2"), ["tracer_id"], "snap", 2)


@query("w13_step_changes", """WITH l AS (SELECT tracer_id, snap, log10(snap + 1) - lag(log10(snap + 1)) OVER w AS step, row_number() OVER w AS k FROM tracks WINDOW w AS (PARTITION BY tracer_id ORDER BY snap)),
    s AS (SELECT tracer_id, snap, k, coalesce(step, lead(step) OVER (PARTITION BY tracer_id ORDER BY snap)) AS step FROM l),
    m AS (SELECT *, coalesce(step < 0.8 * median(step) OVER (PARTITION BY tracer_id), false) AS small FROM s),
    g AS (SELECT *, k - row_number() OVER (PARTITION BY tracer_id, small ORDER BY snap) AS run FROM m)
    SELECT tracer_id, snap FROM (SELECT *, row_number() OVER (PARTITION BY tracer_id, small, run ORDER BY snap) AS place, count(*) OVER (PARTITION BY tracer_id, small, run) AS size FROM g) WHERE NOT small OR size = 1 OR place % 2 = 0""")
def w13(t):
    """Snapshots whose steps are even: where they get small, every second one goes."""
    return H.evened_steps(t.tracks.select("tracer_id", "snap", (F.col("snap") + 1).alias("scale")), "tracer_id", "snap", "scale").select("tracer_id", "snap")


@query("w4b_quadratic_smooth", """WITH r AS (SELECT tracer_id, (max(snap) + min(snap)) / 2.0 AS mid FROM tracks GROUP BY 1 HAVING count(*) >= 3),
    s AS (SELECT tracer_id, any_value(mid) AS mid, CAST(count(*) AS DOUBLE) AS s0, sum(u) AS s1, sum(u * u) AS s2, sum(u * u * u) AS s3, sum(u * u * u * u) AS s4, sum(value) AS v0, sum(value * u) AS v1, sum(value * u * u) AS v2
        FROM (SELECT tracer_id, mid, (snap - mid) / 15.0 AS u, value FROM tracks JOIN r USING (tracer_id)) GROUP BY 1),
    d AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det FROM s),
    c AS (SELECT tracer_id, mid, (v0 * (s2 * s4 - s3 * s3) - s1 * (v1 * s4 - v2 * s3) + s2 * (v1 * s3 - v2 * s2)) / det AS c0, (s0 * (v1 * s4 - v2 * s3) - v0 * (s1 * s4 - s2 * s3) + s2 * (s1 * v2 - s2 * v1)) / det AS c1, (s0 * (s2 * v2 - s3 * v1) - s1 * (s1 * v2 - s2 * v1) + v0 * (s1 * s3 - s2 * s2)) / det AS c2 FROM d)
    SELECT tracer_id, snap, round(c0 + c1 * (snap - mid) / 15.0 + c2 * pow((snap - mid) / 15.0, 2), 4) + 0.0 AS smooth FROM tracks JOIN c USING (tracer_id)""")
def w4b(t):
    rows = t.tracks.join(t.tracks.groupBy("tracer_id").agg(F.count(F.lit(1)).alias("c")).where("c >= 3"), "tracer_id")
    return H.polynomial(rows, "tracer_id", "snap", "value", 2, "smooth").select("tracer_id", "snap", (F.round("smooth", 4) + F.lit(0.0)).alias("smooth"))


#: each tracer's parent id at each snapshot, without its type; the id tables of every snapshot and type; branches with holes
_TP = "(SELECT tracer_id, snap, CAST(tracer_id % 10 * 3 + snap % 3 AS BIGINT) AS parent_id FROM tracks)"
_IDS = "(SELECT CAST(o_orderkey % 30 AS INTEGER) AS snap, CASE left(o_orderpriority, 1) WHEN '1' THEN 'bh' WHEN '2' THEN 'bh' WHEN '3' THEN 'stars' ELSE 'gas' END AS kind, o_orderkey // 30 % 30 AS id, (o_orderkey // 30 % 30 // 3 + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) % 10 AS obj, o_totalprice AS value FROM orders)"
_PAR = f"(SELECT tracer_id, snap, parent_id, kind, obj, value FROM {_TP} LEFT JOIN (SELECT snap, id AS parent_id, kind, obj, value, row_number() OVER (PARTITION BY snap, id ORDER BY CASE kind WHEN 'gas' THEN 1 WHEN 'stars' THEN 2 ELSE 3 END, obj, value) AS k FROM {_IDS}) USING (snap, parent_id) WHERE coalesce(k, 1) = 1)"
_BR = "(SELECT DISTINCT o_custkey % 10 AS root, CAST(o_orderkey % 30 AS INTEGER) AS snap, o_custkey % 10 AS obj FROM orders WHERE (o_custkey % 10 + o_orderkey % 30) % 9 <> 0)"


def parents(t):
    rows = t.tracks.select("tracer_id", "snap", F.expr("cast(tracer_id % 10 * 3 + snap % 3 as bigint)").alias("parent_id"))
    kind = F.expr("CASE left(o_orderpriority, 1) WHEN '1' THEN 'bh' WHEN '2' THEN 'bh' WHEN '3' THEN 'stars' ELSE 'gas' END")
    ids = t.orders.select(F.expr("cast(o_orderkey % 30 as int)").alias("snap"), kind.alias("kind"), F.expr("o_orderkey div 30 % 30").alias("id"), F.expr("(o_orderkey div 30 % 30 div 3 + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) % 10").alias("obj"), F.col("o_totalprice").alias("value"))
    return T.typed_parents(rows, ids, ["gas", "stars", "bh"], "snap", "parent_id", ["obj", "value"])


def branch_rows(t):
    return t.orders.where("(o_custkey % 10 + o_orderkey % 30) % 9 <> 0").select(F.expr("o_custkey % 10").alias("root"), F.expr("cast(o_orderkey % 30 as int)").alias("snap"), F.expr("o_custkey % 10").alias("obj")).distinct()


@query("j20b_typed_parents", f"SELECT tracer_id, snap, parent_id, kind, obj, value FROM {_PAR}")
def j20b(t):
    """The parent of every tracer at every snapshot: its type by precedence, its object, its value."""
    return parents(t)


_FINAL = f"(SELECT tracer_id, coalesce(f.root, -1) AS root FROM (SELECT tracer_id, max_by(coalesce(obj, -1), snap) AS last FROM {_PAR} GROUP BY 1) LEFT JOIN (SELECT DISTINCT obj AS last, obj // 2 * 2 AS root FROM {_IDS}) f USING (last))"


def finals(t):
    """Each tracer's rows with -1 for no object, and the branch of the central of its last halo (two objects each)."""
    found = parents(t).select(F.col("tracer_id").alias("tracer"), "snap", F.coalesce("obj", F.lit(-1)).alias("obj"))
    objects = t.orders.select(F.expr("(o_orderkey div 30 % 30 div 3 + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) % 10").alias("obj")).distinct()
    halo_of = objects.select("obj", F.expr("obj div 2").alias("halo"), F.expr("obj div 2 * 2").alias("first_obj"))
    return found, T.branch_of_final(found, halo_of, branch_rows(t))


@query("j21b_branch_of_final_central", f"SELECT tracer_id AS tracer, CASE WHEN b.obj IS NULL THEN -1 ELSE root END AS root, b.snap, coalesce(b.obj, -1) AS obj FROM {_FINAL} LEFT JOIN {_BR} b USING (root)")
def j21b(t):
    return finals(t)[1]


@query("a69b_accretion_modes", f"""WITH par AS (SELECT tracer_id, snap, coalesce(obj, -1) AS obj FROM {_PAR}), m AS (SELECT f.tracer_id, b.snap, b.obj AS main FROM {_FINAL} f JOIN {_BR} b USING (root)),
    e AS (SELECT tracer_id, min(snap) FILTER (r < 0.5) AS acc FROM tracks GROUP BY 1),
    j AS (SELECT e.tracer_id, acc, par.snap, par.obj, main FROM e LEFT JOIN par USING (tracer_id) LEFT JOIN m ON m.tracer_id = e.tracer_id AND m.snap = par.snap),
    s AS (SELECT tracer_id, acc, max(main) FILTER (snap = acc) AS main, coalesce(max(obj) FILTER (snap = acc), -1) AS obj, coalesce(bool_or(obj <> -1 AND (main IS NULL OR obj <> main)) FILTER (snap <= acc), false) AS other FROM j GROUP BY ALL)
    SELECT tracer_id AS tracer, CASE WHEN acc IS NULL THEN 'none' WHEN acc = (SELECT min(snap) FROM par) THEN 'smooth' WHEN main IS NULL THEN 'none' WHEN obj <> main THEN 'merger' WHEN other THEN 'stripped' ELSE 'smooth' END AS mode FROM s""")
def a69b(t):
    """A tracer's object against the object of the branch it ends in, at the snapshot of entry and before."""
    found, branch = finals(t)
    entered = t.tracks.groupBy(F.col("tracer_id").alias("tracer")).agg(F.min(F.when(F.col("r") < 0.5, F.col("snap"))).alias("acc"))
    return T.accretion_modes(found, branch.where("obj <> -1").select("tracer", "snap", "obj"), entered)


_FORM = "(SELECT o_custkey AS root, CAST(o_orderkey % 30 AS INTEGER) AS snap, min(sub_id) AS sub FROM orders JOIN subs ON sub_id = o_orderkey GROUP BY ALL)"


@query("a66b_formation_in_halo", f"""WITH b AS (SELECT f.root, f.snap, f.sub, f.sub % 50 AS halo, x, y, z, mass, mass * (0.5 + f.sub % 5 / 10.0) AS dm FROM {_FORM} f JOIN subs ON sub_id = f.sub),
    h AS (SELECT snap, halo, min(sub) AS first_sub, min_by(x, sub) AS x, min_by(y, sub) AS y, min_by(z, sub) AS z, CASE WHEN halo % 10 = 0 THEN 0.0 ELSE 20.0 + halo END AS rvir FROM b GROUP BY snap, halo),
    f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY root ORDER BY snap) = 1),
    d AS (SELECT f.*, first_sub, rvir, sqrt(pow(least(abs(f.x - h.x), 1000 - abs(f.x - h.x)), 2) + pow(least(abs(f.y - h.y), 1000 - abs(f.y - h.y)), 2) + pow(least(abs(f.z - h.z), 1000 - abs(f.z - h.z)), 2)) AS d FROM f JOIN h USING (snap, halo))
    SELECT root, snap, CAST(first_sub <> sub AS INTEGER) AS satellite, CASE WHEN d = 0 THEN 0 WHEN rvir = 0 THEN 'inf'::DOUBLE ELSE round(d / rvir, 8) END AS distance_rvir, round(dm / mass, 8) AS dm_fraction FROM d""")
def a66b(t):
    first = t.subs.groupBy(F.col("halo_id").alias("root"), F.expr("cast(sub_id % 30 as int)").alias("snap")).agg(F.min("sub_id").alias("sub"))
    branch = first.join(t.subs.select(F.col("sub_id").alias("sub"), "x", "y", "z", "mass"), "sub").withColumns({"halo": F.expr("sub % 50"), "dm": F.col("mass") * (0.5 + F.expr("sub % 5") / 10.0)})
    halos = branch.groupBy("snap", "halo").agg(F.min("sub").alias("first_sub"), *(F.min_by(d, "sub").alias(d) for d in "xyz")).withColumn("rvir", F.expr("CASE WHEN halo % 10 = 0 THEN 0.0D ELSE 20.0D + halo END"))
    out = T.at_formation(branch, halos, ["x", "y", "z"], 1000.0)
    return out.select("root", "snap", "satellite", F.round("distance_rvir", 8).alias("distance_rvir"), F.round("dm_fraction", 8).alias("dm_fraction"))


@query("a98b_crossing_events", """WITH s AS (SELECT tracer_id, CAST(snap AS DOUBLE) AS t, r, r >= 1.0 + snap * 0.01 AS above, r < 0.6 + snap * 0.01 AS below FROM tracks),
    p AS (SELECT *, lag(t) OVER w AS pt, lag(r) OVER w AS pr, lag(above) OVER w AS was FROM s WINDOW w AS (PARTITION BY tracer_id ORDER BY t)),
    c AS (SELECT *, pt + (1.0 + pt * 0.01 - pr) / ((r - pr) / (t - pt) - 0.01) AS hi, pt + (0.6 + pt * 0.01 - pr) / ((r - pr) / (t - pt) - 0.01) AS lo, above AND NOT coalesce(was, false) AS enters, NOT above AND coalesce(was, false) AS leaves FROM p),
    n AS (SELECT *, count(*) FILTER (enters) OVER (PARTITION BY tracer_id ORDER BY t) AS n FROM c),
    b AS (SELECT tracer_id, min(t) AS start, min_by(below, t) AS b, min_by(coalesce(lo, t), t) FILTER (NOT below) AS stop FROM c GROUP BY 1)
    SELECT tracer_id, 'below' AS event, 1 AS n, start, round(stop, 6) AS stop FROM b WHERE b
    UNION ALL SELECT tracer_id, 'above', n, round(max(coalesce(hi, t)) FILTER (enters), 6), round(max(hi) FILTER (leaves), 6) FROM n WHERE enters OR leaves GROUP BY tracer_id, n""")
def a98b(t):
    """One row for each stay above the upper boundary, and the first exit from below the lower one."""
    out = H.stays_above(t.tracks, "tracer_id", "snap", "r", (0.6, 0.01), (1.0, 0.01))
    return out.select("tracer_id", "event", "n", R6("start").alias("start"), R6("stop").alias("stop"))


@query("w14_first_of_each", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def w14(t):
    from ..sources.logs import first_of_each

    return first_of_each(t.events, ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id")


@query("w15_ranking", "SELECT tracer_id, snap, CAST(rank() OVER (PARTITION BY tracer_id ORDER BY value DESC) AS INTEGER) AS place FROM tracks")
def w15(t):
    return t.tracks.select("tracer_id", "snap", F.rank().over(whole().orderBy(F.desc("value"))).alias("place"))


@query("w16_first_crossing", f"SELECT count(acc) AS found, count(*) AS n, round(avg(acc), 6) AS mean FROM {_ACC}")
def w16(t):
    acc = H.first_inside(t.tracks.withColumn("time", F.col("snap").cast("double")), "tracer_id", "snap", "time", "r", 0.5, "acc")
    return acc.agg(F.count("acc").alias("found"), F.count(F.lit(1)).alias("n"), R6(F.avg("acc")).alias("mean"))


@query("w17_ratio_to_local_mean", """WITH b AS (SELECT tracer_id, CAST(floor(r / 0.5) AS INTEGER) AS b, avg(value) AS m FROM tracks GROUP BY ALL)
    SELECT t.tracer_id, t.snap, round(t.value / (l.m + (coalesce(h.m, l.m) - l.m) * (t.r / 0.5 - floor(t.r / 0.5))), 6) AS ratio FROM tracks t JOIN b l ON l.tracer_id = t.tracer_id AND l.b = floor(t.r / 0.5) LEFT JOIN b h ON h.tracer_id = t.tracer_id AND h.b = floor(t.r / 0.5) + 1""")
def w17(t):
    rows = t.tracks.withColumn("b", F.floor(F.col("r") / 0.5).cast("int"))
    mean = rows.groupBy("tracer_id", "b").agg(F.avg("value").alias("m"))
    upper = mean.select("tracer_id", (F.col("b") - 1).alias("b"), F.col("m").alias("h"))
    out = rows.join(mean, ["tracer_id", "b"]).join(upper, ["tracer_id", "b"], "left")
    local = F.col("m") + (F.coalesce("h", "m") - F.col("m")) * (F.col("r") / 0.5 - F.floor(F.col("r") / 0.5))
    return out.select("tracer_id", "snap", R6(F.col("value") / local).alias("ratio"))


@query("t1_global_sort", "SELECT sub_id, CAST(row_number() OVER (ORDER BY mass, sub_id) - 1 AS BIGINT) AS place FROM subs")
def t1(t):
    return row_index(t.subs, ["mass", "sub_id"], F.floor(F.col("mass") / 5000), name="place").select("sub_id", "place")


@query("t2_mixed_order", "SELECT sub_id, CAST(row_number() OVER (PARTITION BY halo_id ORDER BY class DESC, mass ASC, sub_id) AS INTEGER) AS place FROM subs")
def t2(t):
    w = Window.partitionBy("halo_id").orderBy(F.desc("class"), F.asc("mass"), "sub_id")
    return t.subs.select("sub_id", F.row_number().over(w).alias("place"))


@query("t3_closest_rows", "SELECT sub_id, mass FROM subs ORDER BY abs(mass - 200000), sub_id LIMIT 25")
def t3(t):
    return t.subs.orderBy(F.abs(F.col("mass") - 200000), "sub_id").limit(25).select("sub_id", "mass")


@query("t4_even_sample", """WITH n AS (SELECT count(*) AS n FROM particles), k AS (SELECT k, k * (n - 1) // 49 AS lin, CASE WHEN k = 49 THEN n - 1 ELSE CAST(floor(pow(n - 1, k / 49.0)) AS BIGINT) END AS lg FROM n, range(50) r(k))
    SELECT 'linear' AS kind, row_index, mass FROM k JOIN particles ON row_index = lin UNION ALL SELECT 'log', row_index, mass FROM k JOIN particles ON row_index = lg""")
def t4(t):
    n = t.rows.count()
    kinds = [even_sample(t.particles, "row_index", n, 50, log).select(F.lit(kind).alias("kind"), "row_index", "mass") for kind, log in (("linear", False), ("log", True))]
    return kinds[0].unionByName(kinds[1])


@query("t5_top_per_group", "SELECT halo_id, sub_id, mass FROM (SELECT halo_id, sub_id, mass, row_number() OVER (PARTITION BY halo_id ORDER BY mass DESC, sub_id) AS k FROM subs) WHERE k <= 3")
def t5(t):
    w = Window.partitionBy("halo_id").orderBy(F.desc("mass"), "sub_id")
    return t.subs.withColumn("k", F.row_number().over(w)).where("k <= 3").select("halo_id", "sub_id", "mass")


@query("u1_intersect", "SELECT halo_id FROM subs WHERE mass > 400000 INTERSECT SELECT halo_id FROM subs WHERE mass < 20000")
def u1(t):
    return t.subs.where("mass > 400000").select("halo_id").intersect(t.subs.where("mass < 20000").select("halo_id"))


@query("u2_union", "SELECT s_suppkey AS id, 'supplier' AS kind FROM supplier UNION ALL SELECT c_custkey, 'customer' FROM customer")
def u2(t):
    one = t.supplier.select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind"))
    return one.unionByName(t.customer.select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind")))


@query("u3_difference", "SELECT c_custkey AS id FROM customer EXCEPT ALL SELECT halo_id FROM subs WHERE mass > 450000")
def u3(t):
    return t.customer.select(F.col("c_custkey").alias("id")).exceptAll(t.subs.where("mass > 450000").select("halo_id"))


@query("u4_first_index", "SELECT sub_id, min(row_index) AS first FROM particles GROUP BY 1")
def u4(t):
    return t.particles.groupBy("sub_id").agg(F.min("row_index").alias("first"))


@query("r4_tracks_by_snapshot", "SELECT snap, count(*) AS n, round(sum(value), 2) AS total FROM tracks GROUP BY 1")
def r4(t):
    from ..sources.sinks import scratch
    from ..streaming.incremental import overwrite_snapshots

    path = scratch(t.spark, "tracks")
    overwrite_snapshots(t.tracks, path, "snap")
    overwrite_snapshots(t.tracks.where("snap % 3 = 0"), path, "snap")  # a restarted run replaces only its own
    return t.spark.read.parquet(path).groupBy(F.col("snap").cast("int")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("r1_incremental_profile", "SELECT CAST(halo_id % 50 AS BIGINT) AS obj, CAST(floor(x / 100) AS INTEGER) AS bin, round(sum(mass), 2) AS mass, count(*) AS n FROM particles WHERE halo_id IS NOT NULL GROUP BY ALL")
def r1(t):
    """Chunks come as files of a stream; each batch adds its sums to a table of partial sums."""
    from ..sources.sinks import scratch
    from ..streaming.incremental import accumulate

    rows = t.rows.where("halo_id is not null").select(F.expr("halo_id % 50").alias("obj"), F.floor(F.col("x") / 100).cast("int").alias("bin"), "mass")
    rows.repartition(4).write.parquet(source := scratch(t.spark, "chunks"))
    out = accumulate(t.spark, source, scratch(t.spark, "sums"), ["obj", "bin"], "mass")
    return out.select("obj", "bin", F.round("total", 2).alias("mass"), "n")


@query("r3_stream_deduplicated", "SELECT DISTINCT user_id AS id, event_type AS kind FROM events")
def r3(t):
    from ..sources.sinks import scratch
    from ..streaming.incremental import deduplicated

    lines = t.events.select(F.concat_ws(" ", "user_id", "event_type").alias("value"))
    lines.repartition(3).write.text(source := scratch(t.spark, "log"))
    return deduplicated(t.spark, source, scratch(t.spark, "log-table"), {"id": "long", "kind": "string"}, ["id", "kind"])
