"""Reductions per object, binned statistics, relations, flows."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import binning as B
from ..operators import reduce as R
from ..operators.ordering import prefix_sum
from ..plans.catalogs import Definition, build, reduce_custom, reducer
from ..plans.roles import query

_MI = lambda d: f"(CASE WHEN {d} > 500 THEN {d} - 1000 WHEN {d} < -500 THEN {d} + 1000 ELSE {d} END)"
#: members with their squared distance from their owner's position
_MEMBERS = f"(SELECT p.*, pow({_MI('(p.x - s.x)')}, 2) + pow({_MI('(p.y - s.y)')}, 2) + pow({_MI('(p.z - s.z)')}, 2) AS r2, {_MI('(p.x - s.x)')} AS dx, {_MI('(p.y - s.y)')} AS dy, {_MI('(p.z - s.z)')} AS dz, s.mass AS smass FROM particles p JOIN subs s USING (sub_id))"


def members(t, indexed: bool = False):
    owners = t.subs.select("sub_id", *(F.col(c).alias("s" + c) for c in "xyz"), F.col("mass").alias("smass"))
    rows = (t.particles if indexed else t.rows).join(owners, "sub_id")
    rows = rows.withColumns({"d" + d: C.min_image(F.col(d) - F.col("s" + d), 1000.0) for d in "xyz"})
    return rows.withColumn("r2", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))


R6 = lambda c, n=6: F.round(c, n)
#: the order of the rows of one object, as in the row index
ROW_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "value", "mass", "w"]


@query("a1_aperture_reduction", f"SELECT sub_id, round(coalesce(m, 0), 2) AS mass, round(mean, 9) AS mean, round(top, 2) AS top FROM subs LEFT JOIN (SELECT sub_id, sum(mass) AS m, sum(value * w) / sum(w) AS mean, max(value) AS top FROM {_MEMBERS} WHERE r2 <= 250000 AND pt <> 'R' GROUP BY 1) USING (sub_id)")
def a1(t):
    aggs = {"mass": F.round(F.sum("mass"), 2), "mean": F.round(R.weighted_mean(F.col("value"), F.col("w")), 9), "top": F.round(F.max("value"), 2)}
    return R.aperture(members(t).where("pt <> 'R'"), t.subs, "sub_id", F.col("r2"), (F.lit(0.0), F.lit(250000.0)), aggs, {"mass": 0.0})


@query("a2_scopes", f"SELECT halo_id, round(sum(mass), 2) AS mass, count(*) AS n FROM {_MEMBERS} WHERE r2 <= 160000 GROUP BY 1")
def a2(t):
    return members(t).where("r2 <= 160000").groupBy("halo_id").agg(F.round(F.sum("mass"), 2).alias("mass"), F.count(F.lit(1)).alias("n"))


@query("a3_vector_reduction", "SELECT sub_id, round(sum(mass * vx) / sum(mass), 6) AS vx, round(sum(mass * vy) / sum(mass), 6) AS vy, round(sum(mass * vz) / sum(mass), 6) AS vz FROM particles GROUP BY 1")
def a3(t):
    return t.rows.groupBy("sub_id").agg(*(R6(R.weighted_mean(F.col(v), F.col("mass"))).alias(v) for v in ("vx", "vy", "vz")))


@query("a4_projected_and_slit", f"SELECT sub_id, round(sum(CASE WHEN dx * dx + dy * dy <= 90000 THEN mass ELSE 0 END), 2) AS circle, round(sum(CASE WHEN abs(dx) <= 200 AND abs(dy) <= 50 THEN mass ELSE 0 END), 2) AS slit FROM {_MEMBERS} GROUP BY 1")
def a4(t):
    circle = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") <= 90000
    slit = (F.abs("dx") <= 200) & (F.abs("dy") <= 50)
    inside = lambda c: F.round(F.sum(F.when(c, F.col("mass")).otherwise(0.0)), 2)
    return members(t).groupBy("sub_id").agg(inside(circle).alias("circle"), inside(slit).alias("slit"))


@query("a5_mass_by_type", "SELECT halo_id, round(coalesce(sum(mass) FILTER (pt = 'A'), 0), 2) AS A, round(coalesce(sum(mass) FILTER (pt = 'N'), 0), 2) AS N, round(coalesce(sum(mass) FILTER (pt = 'R'), 0), 2) AS R FROM particles GROUP BY 1")
def a5(t):
    out = t.rows.groupBy("halo_id").pivot("pt", ["A", "N", "R"]).agg(F.sum("mass")).fillna(0.0)
    return out.select("halo_id", *(F.round(c, 2).alias(c) for c in "ANR"))


_CUM = f"(SELECT sub_id, r, mass, row_index, sum(mass) OVER (PARTITION BY sub_id ORDER BY r, row_index) AS c, sum(mass) OVER (PARTITION BY sub_id) AS t, coalesce(lag(r) OVER (PARTITION BY sub_id ORDER BY r, row_index), 0) AS pr FROM (SELECT sub_id, mass, row_index, sqrt(r2) AS r FROM {_MEMBERS}))"
_ENC = lambda f: f"max(CASE WHEN c >= {f} * t AND c - mass < {f} * t THEN pr + ({f} * t - (c - mass)) / mass * (r - pr) END)"


@query("a6_enclosing_radius", f"SELECT sub_id, round({_ENC(0.5)}, 4) AS half, round({_ENC(0.8)}, 4) AS r80 FROM {_CUM} GROUP BY 1")
def a6(t):
    out = R.enclosing_radii(members(t).withColumn("r", F.sqrt("r2")), "sub_id", "r", "mass", {"half": 0.5, "r80": 0.8}, ROW_ORDER)
    return out.select("sub_id", F.round("half", 4).alias("half"), F.round("r80", 4).alias("r80"))


@query("a7_concentration", f"SELECT sub_id, round(5 * log10({_ENC(0.8)} / {_ENC(0.2)}), 4) AS c FROM {_CUM} GROUP BY 1 HAVING {_ENC(0.2)} > 0")
def a7(t):
    out = R.enclosing_radii(members(t).withColumn("r", F.sqrt("r2")), "sub_id", "r", "mass", {"hi": 0.8, "lo": 0.2}, ROW_ORDER).where("lo > 0")
    return out.select("sub_id", F.round(5 * F.log10(F.col("hi") / F.col("lo")), 4).alias("c"))


@query("a8_nth_member_distance", f"SELECT halo_id, round(r2, 2) AS r2 FROM (SELECT halo_id, r2, row_number() OVER (PARTITION BY halo_id ORDER BY r2, row_index) - 1 AS k, count(*) OVER (PARTITION BY halo_id) AS n FROM {_MEMBERS}) WHERE k = least(n - 1, 16)")
def a8(t):
    return R.ordered_value(members(t), "halo_id", "r2", ["sub_id", *ROW_ORDER], 16, "r2")


@query("a9_rotational_support", f"""WITH m AS {_MEMBERS}, c AS (SELECT sub_id, sum(mass * vx) / sum(mass) AS cx, sum(mass * vy) / sum(mass) AS cy, sum(mass * vz) / sum(mass) AS cz FROM m GROUP BY 1)
    SELECT sub_id, round(sum(mass * (dx * (vy - cy) - dy * (vx - cx))), 6) AS jz, round(sum(mass * (pow(vx - cx, 2) + pow(vy - cy, 2) + pow(vz - cz, 2))), 6) AS kinetic FROM m JOIN c USING (sub_id) GROUP BY 1""")
def a9(t):
    """Two passes: the mean velocity of each object, then momenta about it."""
    rows = members(t)
    mean = rows.groupBy("sub_id").agg(*(R.weighted_mean(F.col(v), F.col("mass")).alias("c" + v) for v in ("vx", "vy", "vz")))
    rows = rows.join(mean, "sub_id")
    u = {v: F.col(v) - F.col("c" + v) for v in ("vx", "vy", "vz")}
    jz = F.col("mass") * (F.col("dx") * u["vy"] - F.col("dy") * u["vx"])
    kinetic = F.col("mass") * (u["vx"] * u["vx"] + u["vy"] * u["vy"] + u["vz"] * u["vz"])
    return rows.groupBy("sub_id").agg(F.round(F.sum(jz), 6).alias("jz"), F.round(F.sum(kinetic), 6).alias("kinetic"))


@query("a10_mean_radial_velocity", f"SELECT sub_id, round(sum(mass * (dx * vx + dy * vy + dz * vz) / greatest(sqrt(r2), 1e-16)) / sum(mass), 6) AS vrad FROM {_MEMBERS} GROUP BY 1")
def a10(t):
    v = C.radial_velocity(["dx", "dy", "dz"], ["vx", "vy", "vz"])
    return members(t).groupBy("sub_id").agg(R6(R.weighted_mean(v, F.col("mass"))).alias("vrad"))


@query("a11_velocity_dispersion", "SELECT halo_id, round(sqrt(greatest(sum(mass * vx * vx) / sum(mass) - pow(sum(mass * vx) / sum(mass), 2), 0)), 6) AS sx, round(stddev_pop(vy), 6) AS sy FROM particles GROUP BY 1")
def a11(t):
    return t.rows.groupBy("halo_id").agg(R6(R.weighted_std(F.col("vx"), F.col("mass"))).alias("sx"), R6(F.stddev_pop("vy")).alias("sy"))


@query("a13_inertia_tensor", f"SELECT sub_id, sum(mass * (dy * dy + dz * dz)) AS ixx, sum(-mass * dx * dy) AS ixy FROM {_MEMBERS} GROUP BY 1")
def a13(t):
    return R.inertia(members(t), "sub_id", ["dx", "dy", "dz"], "mass").select("sub_id", "ixx", "ixy")


@query("a14_angular_momentum", f"SELECT sub_id, round(avg(mass * (dy * vz - dz * vy)), 4) AS jx, round(avg(mass * (dz * vx - dx * vz)), 4) AS jy, round(avg(mass * (dx * vy - dy * vx)), 4) AS jz FROM {_MEMBERS} WHERE r2 <= 360000 GROUP BY 1")
def a14(t):
    j = C.cross(["dx", "dy", "dz"], ["vx", "vy", "vz"])
    return members(t).where("r2 <= 360000").groupBy("sub_id").agg(*(F.round(F.avg(F.col("mass") * c), 4).alias(n) for c, n in zip(j, ("jx", "jy", "jz"))))


@query("a24_radial_profile", f"SELECT halo_id, CAST(least(floor(sqrt(r2) / 50), 11) AS INTEGER) AS bin, count(*) AS n, round(sum(mass), 2) AS mass, round(avg(value), 8) AS mean, round(median(value), 4) AS mid FROM {_MEMBERS} WHERE r2 < 360000 GROUP BY ALL")
def a24(t):
    rows = members(t).withColumn("bin", C.bin_index(F.sqrt("r2"), 0.0, 600.0, 12)).where("r2 < 360000")
    return rows.groupBy("halo_id", "bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("mass"), 2).alias("mass"), F.round(F.avg("value"), 8).alias("mean"), F.round(B.median("value"), 4).alias("mid"))


@query("a26_binned_statistic", "SELECT CAST(least(floor((p_retailprice - 900) * 20 / 100), 19) AS INTEGER) AS bin, round(sum(p_size * p_retailprice) / sum(p_retailprice), 6) AS mean FROM part WHERE p_retailprice BETWEEN 900 AND 1000 GROUP BY 1")
def a26(t):
    rows = t.part.withColumn("bin", C.bin_index("p_retailprice", 900.0, 1000.0, 20, closed="numpy"))
    return rows.where("bin is not null").groupBy("bin").agg(R6(R.weighted_mean(F.col("p_size"), F.col("p_retailprice"))).alias("mean"))


@query("a27_weighted_std", "SELECT pt, round(sqrt((sum(w * mass * mass) - pow(sum(w * mass), 2) / sum(w)) / (sum(w) - sum(w * w) / sum(w))), 6) AS std FROM particles GROUP BY 1")
def a27(t):
    return t.rows.groupBy("pt").agg(R6(R.reliability_std(F.col("mass"), F.col("w"))).alias("std"))


@query("a28_binned_2d", "SELECT CAST(floor(x / 100) AS INTEGER) AS ix, CAST(floor(y / 100) AS INTEGER) AS iy, count(*) AS n, round(avg(value), 8) AS mean, round(median(value), 4) AS mid FROM particles GROUP BY ALL")
def a28(t):
    rows = t.rows.withColumns({"ix": C.bin_index("x", 0.0, 1000.0, 10), "iy": C.bin_index("y", 0.0, 1000.0, 10)})
    return rows.groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 8).alias("mean"), F.round(B.median("value"), 4).alias("mid"))


@query("a29_histograms", "WITH h AS (SELECT CAST(floor(x / 100) AS INTEGER) AS ix, CAST(floor(z / 200) AS INTEGER) AS iz, count(*) AS n, sum(mass) AS w FROM particles GROUP BY ALL) SELECT ix, iz, n, round(w, 2) AS w, round(w / max(w) OVER (PARTITION BY ix), 6) AS share, round(w / (sum(w) OVER ()) / 20000, 12) AS density FROM h")
def a29(t):
    h = B.histogram(t.rows, {"ix": C.bin_index("x", 0.0, 1000.0, 10), "iz": C.bin_index("z", 0.0, 1000.0, 5)}, F.col("mass"))
    total = t.rows.agg(F.sum("mass")).first()[0]
    return B.column_share(h, "ix").select("ix", "iz", "n", F.round("w", 2).alias("w"), R6("share").alias("share"), F.round(F.col("w") / F.lit(total) / 20000, 12).alias("density"))


@query("a36_column_density_distribution", "SELECT CAST(floor(log10(value) * 10) AS INTEGER) AS bin, count(*) AS n, round(count(*) / (pow(10, (floor(log10(value) * 10) + 1) / 10) - pow(10, floor(log10(value) * 10) / 10)) / (SELECT count(*) FROM particles) / 0.5, 12) AS f FROM particles GROUP BY bin, floor(log10(value) * 10)")
def a36(t):
    total = t.rows.count()
    rows = t.rows.withColumn("bin", F.floor(F.log10("value") * 10).cast("int")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    width = F.pow(F.lit(10.0), (F.col("bin") + 1) / 10) - F.pow(F.lit(10.0), F.col("bin") / 10)
    return rows.withColumn("f", F.round(F.col("n") / width / total / 0.5, 12))


@query("a37_cosmic_density", "SELECT pt, round(sum(mass) / 1e9 / 27.75, 12) AS omega FROM particles GROUP BY 1")
def a37(t):
    return t.rows.groupBy("pt").agg(F.round(F.sum("mass") / 1e9 / 27.75, 12).alias("omega"))


@query("a41_flux_histogram", f"""SELECT rbin, vbin, pt, round(sum(m), 4) AS mass_flux, round(sum(m * v * v / 2), 2) AS energy_flux, count(*) AS n FROM
    (SELECT pt, CAST(floor(sqrt(r2) / 100) AS INTEGER) AS rbin, CAST(floor(v / 50) AS INTEGER) AS vbin, v, mass * v / 100 AS m FROM (SELECT pt, r2, mass, (dx * vx + dy * vy + dz * vz) / greatest(sqrt(r2), 1e-16) AS v FROM {_MEMBERS}) WHERE r2 < 360000) GROUP BY ALL""")
def a41(t):
    return flux(t).groupBy("rbin", "vbin", "pt").agg(F.round(F.sum("m"), 4).alias("mass_flux"), F.round(F.sum(F.col("m") * F.col("v") * F.col("v") / 2), 2).alias("energy_flux"), F.count(F.lit(1)).alias("n"))


def flux(t):
    rows = members(t).where("r2 < 360000").withColumn("v", C.radial_velocity(["dx", "dy", "dz"], ["vx", "vy", "vz"]))
    return rows.withColumns({"rbin": F.floor(F.sqrt("r2") / 100).cast("int"), "vbin": F.floor(F.col("v") / 50).cast("int"), "m": F.col("mass") * F.col("v") / 100})


_FLUX = f"(SELECT halo_id, pt, CAST(floor(sqrt(r2) / 100) AS INTEGER) AS rbin, CAST(floor(v / 50) AS INTEGER) AS vbin, v, mass * v / 100 AS m FROM (SELECT halo_id, pt, r2, mass, (dx * vx + dy * vy + dz * vz) / greatest(sqrt(r2), 1e-16) AS v FROM {_MEMBERS}) WHERE r2 < 360000)"


@query("a42_fluxes_above_cuts", f"SELECT coalesce(rbin, -1) AS rbin, vbin, round(sum(sum(m)) OVER (PARTITION BY rbin ORDER BY vbin DESC), 2) AS above FROM {_FLUX} GROUP BY GROUPING SETS ((rbin, vbin), (vbin))")
def a42(t):
    sums = flux(t).groupBy("rbin", "vbin").agg(F.sum("m").alias("m"))
    both = sums.unionByName(sums.groupBy("vbin").agg(F.sum("m").alias("m")).withColumn("rbin", F.lit(-1)))
    return both.select("rbin", "vbin", F.round(F.sum("m").over(Window.partitionBy("rbin").orderBy(F.desc("vbin"))), 2).alias("above"))


@query("a43_loading_factors", f"SELECT halo_id, round(coalesce(o, 0) / n, 8) AS eta FROM (SELECT halo_id, sum(m) FILTER (v > 0) AS o FROM {_FLUX} GROUP BY 1) RIGHT JOIN (SELECT halo_id, sum(mass) AS n FROM subs GROUP BY 1) USING (halo_id)")
def a43(t):
    out = flux(t).where("v > 0").groupBy("halo_id").agg(F.sum("m").alias("o"))
    norm = t.subs.groupBy("halo_id").agg(F.sum("mass").alias("n"))
    return norm.join(out, "halo_id", "left").select("halo_id", F.round(F.coalesce("o", F.lit(0.0)) / F.when(F.col("n") != 0, F.col("n")), 8).alias("eta"))


@query("a44_outflow_velocity_percentiles", f"""WITH b AS (SELECT rbin, vbin, sum(m) AS m FROM {_FLUX} WHERE v > 0 GROUP BY ALL),
    c AS (SELECT *, sum(m) OVER (PARTITION BY rbin ORDER BY vbin DESC) AS c, sum(m) OVER (PARTITION BY rbin) AS t FROM b)
    SELECT rbin, round(max(CASE WHEN c >= 0.25 * t AND c - m < 0.25 * t THEN (vbin + 1) * 50 - 50 * (0.25 * t - (c - m)) / m END), 4) AS v75 FROM c GROUP BY 1""")
def a44(t):
    b = flux(t).where("v > 0").groupBy("rbin", "vbin").agg(F.sum("m").alias("m"))
    c = b.withColumn("c", F.sum("m").over(Window.partitionBy("rbin").orderBy(F.desc("vbin")))).withColumn("t", F.sum("m").over(Window.partitionBy("rbin")))
    goal = F.col("t") * 0.25
    at = (F.col("vbin") + 1) * 50 - 50 * (goal - (F.col("c") - F.col("m"))) / F.col("m")
    return c.where((F.col("c") >= goal) & (F.col("c") - F.col("m") < goal)).groupBy("rbin").agg(F.round(F.max(at), 4).alias("v75"))


@query("a45_running_median", """WITH RECURSIVE l AS (SELECT min(p_size) AS lo, (max(p_size) - min(p_size)) / 11.0 AS step FROM part),
    b AS (SELECT k, (SELECT count(*) FROM part, l WHERE p_size >= lo + k * step AND (k = 11 OR p_size < lo + (k + 1) * step)) AS c FROM range(12) r(k)),
    w(k, edge, held) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), c FROM b WHERE k = 0 UNION ALL SELECT b.k, CASE WHEN held >= 100 THEN b.k ELSE edge END, CASE WHEN held >= 100 THEN b.c ELSE held + b.c END FROM w JOIN b ON b.k = w.k + 1),
    e AS (SELECT edge, row_number() OVER (ORDER BY edge) - 1 AS bin, lo + edge * step AS start FROM (SELECT edge, arg_max(held, k) AS held, max(k) AS k FROM w GROUP BY 1), l WHERE NOT (k = 11 AND held < 50 AND edge > 0)),
    f AS (SELECT p_size, p_retailprice, (SELECT max(bin) FROM e WHERE start <= p_size) AS bin FROM part)
    SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(median(p_size), 4) AS x_mid, round(median(p_retailprice), 4) AS y_mid, round(avg(p_retailprice), 4) AS y_mean, round(stddev_pop(p_retailprice), 4) AS y_std, round(quantile_cont(p_retailprice, 0.16), 4) AS p16, round(quantile_cont(p_retailprice, 0.84), 4) AS p84 FROM f GROUP BY 1""")
def a45(t):
    edges = B.adaptive_edges(t.part, "p_size", 12, 100)
    out = B.running(t.part, "p_size", "p_retailprice", edges, [16, 84])
    return out.select("bin", "n", *(F.round(c, 4).alias(c) for c in ("x_mid", "y_mid", "y_mean", "y_std", "p16", "p84")))


@query("a46_clipped_running_median", """WITH b AS (SELECT CAST(floor(p_size / 5) AS INTEGER) AS bin, p_size, p_retailprice AS y FROM part), l AS (SELECT bin, quantile_cont(y, 0) AS lo, quantile_cont(y, 0.9) AS hi FROM b GROUP BY 1)
    SELECT bin, count(*) AS n, round(median(p_size), 4) AS x, round(median(y), 4) AS y FROM b JOIN l USING (bin) WHERE y BETWEEN lo AND hi GROUP BY 1""")
def a46(t):
    rows = B.clipped(t.part.withColumn("bin", F.floor(F.col("p_size") / 5).cast("int")), "bin", "p_retailprice", 0, 90)
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(B.median("p_size"), 4).alias("x"), F.round(B.median("p_retailprice"), 4).alias("y"))


@query("a47_running_median_split", """WITH b AS (SELECT CAST(floor(p_size / 5) AS INTEGER) AS bin, p_partkey % 97 AS s, p_retailprice AS y FROM part), l AS (SELECT bin, quantile_cont(s, 0.75) AS cut FROM b GROUP BY 1)
    SELECT bin, s > cut AS above, round(median(y), 4) AS y FROM b JOIN l USING (bin) GROUP BY ALL""")
def a47(t):
    rows = t.part.withColumns({"bin": F.floor(F.col("p_size") / 5).cast("int"), "s": F.expr("p_partkey % 97")})
    cut = rows.groupBy("bin").agg(F.percentile("s", F.lit(0.75)).alias("cut"))
    return rows.join(cut, "bin").withColumn("above", F.col("s") > F.col("cut")).groupBy("bin", "above").agg(F.round(B.median("p_retailprice"), 4).alias("y"))


@query("a48_offset_from_relation", "SELECT p_partkey, round(p_retailprice - median(p_retailprice) OVER (PARTITION BY floor(p_size / 5)), 4) AS offset_y FROM part")
def a48(t):
    rows = t.part.withColumn("bin", F.floor(F.col("p_size") / 5))
    mid = rows.groupBy("bin").agg(B.median("p_retailprice").alias("mid"))
    return rows.join(mid, "bin").select("p_partkey", F.round(F.col("p_retailprice") - F.col("mid"), 4).alias("offset_y"))


@query("a49_pixel_fractions", "SELECT CAST(floor(x / 200) AS INTEGER) AS ix, CAST(floor(y / 200) AS INTEGER) AS iy, round(avg(CASE WHEN mass > 250000 THEN 1.0 ELSE 0.0 END), 6) AS share FROM subs GROUP BY ALL")
def a49(t):
    rows = t.subs.groupBy(F.floor(F.col("x") / 200).cast("int").alias("ix"), F.floor(F.col("y") / 200).cast("int").alias("iy"))
    return rows.agg(R6(F.avg(F.when(F.col("mass") > 250000, 1.0).otherwise(0.0))).alias("share"))


@query("a50_stacked_profiles", f"WITH p AS (SELECT halo_id, CAST(floor(sqrt(r2) / 100) AS INTEGER) AS bin, sum(mass) AS m FROM {_MEMBERS} GROUP BY ALL) SELECT bin, count(*) AS n, round(avg(m), 4) AS mean, round(median(m), 4) AS mid, round(quantile_cont(m, 0.84), 4) AS p84, round(avg(m) / ({4 / 3 * math.pi!r} * (pow((bin + 1) * 100.0, 3) - pow(bin * 100.0, 3))), 12) AS density FROM p GROUP BY 1")
def a50(t):
    p = members(t).groupBy("halo_id", F.floor(F.sqrt("r2") / 100).cast("int").alias("bin")).agg(F.sum("mass").alias("m"))
    volume = (F.pow((F.col("bin") + 1) * 100.0, F.lit(3.0)) - F.pow(F.col("bin") * 100.0, F.lit(3.0))) * (4 / 3 * math.pi)
    out = p.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("m").alias("mean"), B.median("m").alias("mid"), F.percentile("m", F.lit(0.84)).alias("p84"))
    return out.select("bin", "n", F.round("mean", 4).alias("mean"), F.round("mid", 4).alias("mid"), F.round("p84", 4).alias("p84"), F.round(F.col("mean") / volume, 12).alias("density"))


@query("a51_binned_totals", "SELECT CAST(floor(vx / 25) AS INTEGER) AS bin, round(sum(mass), 2) AS total, round(sum(sum(mass)) OVER (PARTITION BY floor(vx / 25) >= 0 ORDER BY abs(floor(vx / 25) + 0.5)) / sum(sum(mass)) OVER (PARTITION BY floor(vx / 25) >= 0), 8) AS share FROM particles GROUP BY bin, floor(vx / 25)")
def a51(t):
    """Cumulative shares away from zero on either side of it."""
    b = t.rows.groupBy(F.floor(F.col("vx") / 25).cast("int").alias("bin")).agg(F.sum("mass").alias("total"))
    side = Window.partitionBy(F.col("bin") >= 0)
    return b.select("bin", F.round("total", 2).alias("total"), F.round(F.sum("total").over(side.orderBy(F.abs(F.col("bin") + 0.5))) / F.sum("total").over(side), 8).alias("share"))


@query("a52_selected_relation", "SELECT p_size, round(median(p_retailprice), 4) AS mid, count(*) AS n FROM part WHERE p_partkey % 7 BETWEEN 1 AND 3 GROUP BY 1")
def a52(t):
    return t.part.where("p_partkey % 7 between 1 and 3").groupBy("p_size").agg(F.round(B.median("p_retailprice"), 4).alias("mid"), F.count(F.lit(1)).alias("n"))


@query("a53_mass_functions", "SELECT CAST(floor(log10(s.mass) / 0.2) AS INTEGER) AS bin, count(*) AS n, count(*) FILTER (s.sub_id = h.first_sub) AS centrals FROM subs s JOIN halos h USING (halo_id) GROUP BY 1")
def a53(t):
    rows = t.subs.join(t.halos.select("halo_id", "first_sub"), "halo_id")
    return rows.groupBy(F.floor(F.log10("mass") / 0.2).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sub_id") == F.col("first_sub")).alias("centrals"))


@query("a54_distinct", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(*) = count(DISTINCT (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS is_key FROM lineitem")
def a54(t):
    key = F.count_distinct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return t.lineitem.agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"), (F.count(F.lit(1)) == key).alias("is_key"))


@query("a61_contamination", f"SELECT halo_id, count(*) FILTER (pt = 'R') AS low, round(sum(mass) FILTER (pt = 'R') / sum(mass), 8) AS share, round(min(r2) FILTER (pt = 'R'), 2) AS nearest FROM {_MEMBERS} WHERE r2 < 250000 GROUP BY 1")
def a61(t):
    low = F.col("pt") == "R"
    return members(t).where("r2 < 250000").groupBy("halo_id").agg(F.count_if(low).alias("low"), F.round(F.sum(F.when(low, F.col("mass"))) / F.sum("mass"), 8).alias("share"), F.round(F.min(F.when(low, F.col("r2"))), 2).alias("nearest"))


@query("a62_overdensity_radius", f"""WITH c AS (SELECT halo_id, r, sum(mass) OVER (PARTITION BY halo_id ORDER BY r, row_index ROWS UNBOUNDED PRECEDING) AS m FROM (SELECT halo_id, row_index, mass, sqrt(r2) AS r FROM {_MEMBERS}) WHERE r > 0)
    SELECT halo_id, round(max(r) FILTER (m / ({4 / 3 * math.pi!r} * pow(r, 3)) > 2e-6), 4) AS r2, round(max(r) FILTER (m / ({4 / 3 * math.pi!r} * pow(r, 3)) > 5e-6), 4) AS r5 FROM c GROUP BY 1""")
def a62(t):
    rows = members(t).withColumn("r", F.sqrt("r2"))
    return R.overdensity(rows, "halo_id", "r", "mass", ["sub_id", *ROW_ORDER], [2, 5], 1e-6).select("halo_id", F.round("r2", 4).alias("r2"), F.round("r5", 4).alias("r5"))


@query("a63_enclosed_mass", f"SELECT row_index, round(sum(mass) OVER (PARTITION BY halo_id ORDER BY r2, row_index ROWS UNBOUNDED PRECEDING), 2) AS enclosed FROM {_MEMBERS}")
def a63(t):
    """Running sums within a halo in two levels: squared distance in steps first."""
    rows = prefix_sum(members(t, True), "mass", ["r2", "row_index"], F.floor(F.col("r2") / 50000), ["halo_id"], "enclosed")
    return rows.select("row_index", F.round("enclosed", 2).alias("enclosed"))


@query("a85_formation_history", "SELECT CAST(year(o_orderdate) AS INTEGER) AS age, round(sum(o_totalprice) / 365.0, 2) AS rate, round(sum(sum(o_totalprice)) OVER (ORDER BY year(o_orderdate)), 0) AS total FROM orders GROUP BY 1, year(o_orderdate)")
def a85(t):
    b = t.orders.groupBy(F.year("o_orderdate").alias("age")).agg(F.sum("o_totalprice").alias("m"))
    return b.select("age", F.round(F.col("m") / 365.0, 2).alias("rate"), F.round(F.sum("m").over(Window.orderBy("age")), 0).alias("total"))


@query("a86_sample_per_bin", "SELECT bin, sub_id FROM (SELECT CAST(floor(mass / 50000) AS INTEGER) AS bin, sub_id, row_number() OVER (PARTITION BY floor(mass / 50000) ORDER BY (sub_id * 7919) % 1000003, sub_id) AS k FROM subs) WHERE k <= 20")
def a86(t):
    return B.sample_per_bin(t.subs.withColumn("bin", F.floor(F.col("mass") / 50000).cast("int")), "bin", 20, "sub_id").select("bin", "sub_id")


@query("a89_compare_columns", "SELECT name, CAST(floor(v / 100) AS INTEGER) AS bin, count(*) FILTER (halo_id % 2 = 0) AS a, count(*) FILTER (halo_id % 2 = 1) AS b FROM (UNPIVOT (SELECT halo_id, x, y, z FROM subs) ON x, y, z INTO NAME name VALUE v) GROUP BY ALL")
def a89(t):
    long = t.subs.unpivot(["halo_id"], ["x", "y", "z"], "name", "v")
    return long.groupBy("name", F.floor(F.col("v") / 100).cast("int").alias("bin")).agg(F.count_if(F.expr("halo_id % 2 = 0")).alias("a"), F.count_if(F.expr("halo_id % 2 = 1")).alias("b"))


@query("a90_limits", "SELECT pt, min(value) AS lo, max(value) AS hi, round(quantile_cont(value, 0.1), 4) AS p10, round(quantile_cont(value, 0.9), 4) AS p90 FROM particles GROUP BY 1")
def a90(t):
    return t.rows.groupBy("pt").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.percentile("value", F.lit(0.1)), 4).alias("p10"), F.round(F.percentile("value", F.lit(0.9)), 4).alias("p90"))


@query("a91_totals_per_snapshot", "SELECT CAST(year(l_shipdate) AS INTEGER) AS snap, l_returnflag AS pt, count(*) AS n, round(sum(l_quantity), 2) AS mass FROM lineitem GROUP BY ALL")
def a91(t):
    return t.lineitem.groupBy(F.year("l_shipdate").alias("snap"), F.col("l_returnflag").alias("pt")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("mass"))


@query("a95_matched_ratio", "SELECT CAST(floor(log10(a.mass) * 10) AS INTEGER) AS bin, count(*) AS n, round(median(b.mass / a.mass), 6) AS ratio FROM subs a JOIN subs b ON b.sub_id = a.sub_id + 1 GROUP BY 1")
def a95(t):
    b = t.subs.select((F.col("sub_id") - 1).alias("sub_id"), F.col("mass").alias("other"))
    rows = t.subs.join(b, "sub_id")
    return rows.groupBy(F.floor(F.log10("mass") * 10).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), R6(B.median(F.col("other") / F.col("mass"))).alias("ratio"))


@query("a96_stacked_flux", f"SELECT CAST(halo_id % 4 AS INTEGER) AS mass_bin, rbin, round(avg(f), 4) AS mean, round(median(f), 4) AS mid FROM (SELECT halo_id, rbin, sum(m) AS f FROM {_FLUX} GROUP BY ALL) GROUP BY 1, 2")
def a96(t):
    f = flux(t).groupBy("halo_id", "rbin").agg(F.sum("m").alias("f"))
    return f.groupBy(F.expr("cast(halo_id % 4 as int)").alias("mass_bin"), "rbin").agg(F.round(F.avg("f"), 4).alias("mean"), F.round(B.median("f"), 4).alias("mid"))


@query("a100_phase_fractions", "SELECT halo_id, round(sum(mass) FILTER (w > 0.05) / sum(mass), 8) AS hot, round(sum(mass) FILTER (w <= 0.05 AND value > 50000) / sum(mass), 8) AS dense FROM particles GROUP BY 1")
def a100(t):
    share = lambda c: F.round(F.sum(F.when(F.expr(c), F.col("mass"))) / F.sum("mass"), 8)
    return t.rows.groupBy("halo_id").agg(share("w > 0.05").alias("hot"), share("w <= 0.05 and value > 50000").alias("dense"))


@query("a101_surface_brightness", f"SELECT CAST(floor(sqrt(dx * dx + dy * dy) / 50) AS INTEGER) AS bin, round(sum(mass) / ({math.pi!r} * (pow((floor(sqrt(dx * dx + dy * dy) / 50) + 1) * 50, 2) - pow(floor(sqrt(dx * dx + dy * dy) / 50) * 50, 2))), 8) AS sb FROM {_MEMBERS} GROUP BY bin, floor(sqrt(dx * dx + dy * dy) / 50)")
def a101(t):
    k = F.floor(C.magnitude("dx", "dy") / 50).cast("int")
    rows = members(t).groupBy(k.alias("bin")).agg(F.sum("mass").alias("m"))
    area = (F.pow((F.col("bin") + 1) * 50.0, F.lit(2.0)) - F.pow(F.col("bin") * 50.0, F.lit(2.0))) * math.pi
    return rows.select("bin", F.round(F.col("m") / area, 8).alias("sb"))


@query("a102_pick_per_bin", "SELECT bin, halo_id, first_sub FROM (SELECT CAST(floor(m200 / 500000) AS INTEGER) AS bin, halo_id, first_sub, row_number() OVER (PARTITION BY floor(m200 / 500000) ORDER BY halo_id) AS k FROM halos) WHERE k <= 5")
def a102(t):
    w = Window.partitionBy("bin").orderBy("halo_id")
    return t.halos.withColumn("bin", F.floor(F.col("m200") / 500000).cast("int")).withColumn("k", F.row_number().over(w)).where("k <= 5").select("bin", "halo_id", "first_sub")


@query("a106_cells_per_owner", "SELECT owner, count(*) AS cells FROM (SELECT floor(x / 25) AS ix, floor(y / 25) AS iy, floor(z / 25) AS iz, min(halo_id) AS owner, max(halo_id) AS other FROM subs GROUP BY ALL) WHERE owner = other GROUP BY 1")
def a106(t):
    cell = [F.floor(F.col(d) / 25).alias("i" + d) for d in "xyz"]
    cells = t.subs.groupBy(*cell).agg(F.min("halo_id").alias("owner"), F.max("halo_id").alias("other"))
    return cells.where("owner = other").groupBy("owner").agg(F.count(F.lit(1)).alias("cells"))


@query("x4_shared_scan_catalogs", f"SELECT sub_id, round(coalesce(a, 0), 2) AS a, round(b, 9) AS b, coalesce(c, 0) AS c FROM subs LEFT JOIN (SELECT sub_id, sum(mass) FILTER (pt = 'A' AND r2 <= 90000) AS a, sum(value * w) FILTER (pt = 'N') / sum(w) FILTER (pt = 'N') AS b, count(mass) FILTER (mass > 25) AS c FROM {_MEMBERS} GROUP BY 1) USING (sub_id)")
def x4(t):
    defs = {"a": Definition("sum", "mass", "A", aperture="300"), "b": Definition("mean", "value", "N", "w"), "c": Definition("count", "mass", rules={"mass": ["gt", 25]})}
    out = build(members(t), t.subs, "sub_id", defs, "pt", "r2")
    return out.select("sub_id", F.round("a", 2).alias("a"), F.round("b", 9).alias("b"), "c")


@reducer("trimmed_mean")
def trimmed_mean(pdf) -> float:
    v = pdf["value"].sort_values()
    kept = v.iloc[len(v) // 10 : len(v) - len(v) // 10]
    return round(kept.sum(), 2) / len(kept)


@query("x2_custom_reduction", "SELECT halo_id, round(round(sum(value), 2) / count(*), 8) AS trimmed_mean FROM (SELECT halo_id, value, row_number() OVER (PARTITION BY halo_id ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY halo_id) AS n FROM particles WHERE halo_id IS NOT NULL) WHERE k >= n // 10 AND k < n - n // 10 GROUP BY 1")
def x2(t):
    return reduce_custom(t.rows.select("halo_id", "value").where("halo_id is not null"), "halo_id", "trimmed_mean").select("halo_id", F.round("trimmed_mean", 8).alias("trimmed_mean"))


def softest(parts) -> float:
    top = parts[:, 0].max()
    return top + math.log((parts[:, 1] * [math.exp(p - top) for p in parts[:, 0]]).sum())


@reducer("log_total", finish=softest)
def log_total(pdf) -> list[float]:
    """The largest value of a part, and the sum of exp(value - largest): parts add up without overflow."""
    v = pdf["value"].to_numpy() / 100
    return [v.max(), sum(math.exp(x - v.max()) for x in v)]


@query("x2b_reduction_in_parts", "SELECT halo_id, round(any_value(top) + ln(sum(exp(value / 100 - top))), 6) AS log_total FROM particles JOIN (SELECT halo_id, max(value) / 100 AS top FROM particles GROUP BY 1) USING (halo_id) GROUP BY 1")
def x2b(t):
    """A reduction that is put together from parts, so an object may have any number of rows."""
    rows = t.rows.select("halo_id", "value").where("halo_id is not null")
    return reduce_custom(rows, "halo_id", "log_total", most=100_000).select("halo_id", F.round("log_total", 6).alias("log_total"))
