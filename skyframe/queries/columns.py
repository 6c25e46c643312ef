"""Scalar and array functions over rows."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import columns as C
from ..functions.physics import SimContext
from ..operators import lookup as L
from ..plans.roles import query

SIM = SimContext()
_MI = lambda d: f"(CASE WHEN {d} > 500 THEN {d} - 1000 WHEN {d} < -500 THEN {d} + 1000 ELSE {d} END)"


@query("f1_field_registry", "SELECT row_index, round(log10(mass), 6) AS mass_log, x - 500 AS delta_x FROM particles WHERE pt = 'R'")
def f1(t):
    from ..sources.particles import FIELDS

    rows = FIELDS.load(t.particles.where("pt = 'R'"), ["row_index", "mass_log", "delta_x"])
    return rows.withColumn("mass_log", F.round("mass_log", 6))


@query("f2_logarithms", "SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN round(log10(s_acctbal - 5000), 6) END AS a, round(log10(CASE WHEN s_acctbal > 5000 THEN s_acctbal - 5000 ELSE 1.0 END), 6) AS b, round(log10(CASE WHEN s_acctbal > 5000 THEN s_acctbal - 5000 ELSE (SELECT min(s_acctbal - 5000) * 0.01 FROM supplier WHERE s_acctbal > 5000) END), 6) AS c FROM supplier")
def f2(t):
    x = F.col("s_acctbal") - 5000
    least = t.supplier.where(x > 0).agg(F.min(x)).first()[0]
    return t.supplier.select("s_suppkey", F.round(C.log_or_null(x), 6).alias("a"), F.round(C.log_or(x), 6).alias("b"), F.round(F.log10(F.when(x > 0, x).otherwise(F.lit(least) * 0.01)), 6).alias("c"))


@query("f3_units", f"SELECT sub_id, round(mass * {1e10 / 0.6774!r} / 1e10, 4) AS mass, round(x * {1 / 0.6774!r}, 6) AS x, round(vx * 1.0, 6) AS vx FROM subs")
def f3(t):
    return t.subs.select("sub_id", F.round(SIM.mass_msun("mass") / 1e10, 4).alias("mass"), F.round(SIM.length_kpc("x"), 6).alias("x"), F.round(SIM.velocity_kms("vx"), 6).alias("vx"))


@query("f4_temperature", "SELECT row_index, round(value * ((2.0 / 3.0) / 1.380650e-16 * 1e10 * 1.672622e-24) * (4.0 / (1.0 + 3.0 * 0.76 + 4.0 * 0.76 * w)), 2) AS temperature FROM particles WHERE pt = 'R'")
def f4(t):
    return t.particles.where("pt = 'R'").select("row_index", F.round(SIM.temperature("value", "w"), 2).alias("temperature"))


@query("f5_thermodynamics", f"""SELECT row_index, round(value * mass * (2.0 / 3.0), 2) AS pressure, round(value * mass * (2.0 / 3.0) / pow(mass, 5.0 / 3.0), 4) AS entropy, round(sqrt(value * (5.0 / 3.0 * (2.0 / 3.0))), 6) AS sound,
    round({math.pi ** 2.5 / 6!r} * pow(sqrt(value * (5.0 / 3.0 * (2.0 / 3.0))), 3.0) / sqrt(mass) / 1e6, 6) AS jeans, round(vx * vx / {8 * math.pi!r}, 6) AS magnetic FROM particles WHERE pt = 'A'""")
def f5(t):
    r = t.particles.where("pt = 'A'")
    return r.select("row_index", F.round(SIM.pressure("value", "mass"), 2).alias("pressure"), F.round(SIM.entropy("value", "mass"), 4).alias("entropy"), F.round(SIM.sound_speed("value"), 6).alias("sound"), F.round(SIM.jeans_mass("value", "mass") / 1e6, 6).alias("jeans"), F.round(SIM.magnetic_pressure("vx"), 6).alias("magnetic"))


@query("f6_element_ratios", "SELECT row_index, round(log10((w / mass) / (0.0134 / 0.7381)), 6) AS ratio, round(w * mass, 6) AS metal_mass FROM particles WHERE pt = 'N'")
def f6(t):
    return t.particles.where("pt = 'N'").select("row_index", F.round(F.log10((F.col("w") / F.col("mass")) / F.lit(0.0134 / 0.7381)), 6).alias("ratio"), F.round(F.col("w") * F.col("mass"), 6).alias("metal_mass"))


@query("f7_magnitude", "SELECT sub_id, round(sqrt(vx * vx + vy * vy + vz * vz), 6) AS v FROM subs")
def f7(t):
    return t.subs.select("sub_id", F.round(C.magnitude("vx", "vy", "vz"), 6).alias("v"))


@query("f8_minimum_image", f"SELECT sub_id, {_MI('(x - 900)')} AS dx, (x + 700) % 1000 AS wx FROM subs")
def f8(t):
    return t.subs.select("sub_id", C.min_image(F.col("x") - 900, 1000.0).alias("dx"), C.wrapped(F.col("x") + 700, 1000.0).alias("wx"))


@query("f9_periodic_distance", f"SELECT sub_id, round(sqrt(pow({_MI('(x - 100)')}, 2) + pow({_MI('(y - 900)')}, 2) + pow({_MI('(z - 500)')}, 2)), 6) AS d3, round(sqrt(pow({_MI('(x - 100)')}, 2) + pow({_MI('(y - 900)')}, 2)), 6) AS d2, greatest(abs({_MI('(x - 100)')}), abs({_MI('(y - 900)')}), abs({_MI('(z - 500)')})) AS dc, pow({_MI('(x - 100)')}, 2) + pow({_MI('(y - 900)')}, 2) + pow({_MI('(z - 500)')}, 2) AS sq FROM subs")
def f9(t):
    c = [F.lit(100.0), F.lit(900.0), F.lit(500.0)]
    return t.subs.select("sub_id", F.round(C.separation("xyz", c, 1000.0), 6).alias("d3"), F.round(C.separation("xy", c[:2], 1000.0), 6).alias("d2"), C.separation("xyz", c, 1000.0, "chebyshev").alias("dc"), C.separation("xyz", c, 1000.0, "squared").alias("sq"))


@query("f10_relative_fields", f"""SELECT row_index, round(sqrt(dx * dx + dy * dy + dz * dz), 6) AS rad, round(sqrt(dx * dx + dy * dy), 6) AS rad2d, round((dx * ux + dy * uy + dz * uz) / greatest(sqrt(dx * dx + dy * dy + dz * dz), 1e-16) + 0.1 * sqrt(dx * dx + dy * dy + dz * dz), 6) AS vrad,
    mass * (dx * uy - dy * ux) AS jz FROM (SELECT row_index, p.mass, {_MI('(p.x - s.x)')} AS dx, {_MI('(p.y - s.y)')} AS dy, {_MI('(p.z - s.z)')} AS dz, p.vx - s.vx AS ux, p.vy - s.vy AS uy, p.vz - s.vz AS uz FROM particles p JOIN subs s USING (sub_id) WHERE pt = 'R')""")
def f10(t):
    owners = t.subs.select("sub_id", *(F.col(c).alias("s" + c) for c in ("x", "y", "z", "vx", "vy", "vz")))
    rows = t.particles.where("pt = 'R'").join(owners, "sub_id")
    pos = [C.min_image(F.col(d) - F.col("s" + d), 1000.0) for d in "xyz"]
    vel = [F.col(v) - F.col("s" + v) for v in ("vx", "vy", "vz")]
    rows = rows.select("row_index", "mass", *(p.alias("d" + d) for p, d in zip(pos, "xyz")), *(v.alias("u" + d) for v, d in zip(vel, "xyz")))
    d, u = ["dx", "dy", "dz"], ["ux", "uy", "uz"]
    return rows.select("row_index", F.round(C.magnitude(*d), 6).alias("rad"), F.round(C.magnitude("dx", "dy"), 6).alias("rad2d"), F.round(C.radial_velocity(d, u, 0.1), 6).alias("vrad"), (F.col("mass") * C.cross(d, u)[2]).alias("jz"))


@query("f11_restrictions", "SELECT row_index FROM particles WHERE mass > 10 AND value <= 20000 AND x >= 100 AND x < 400 AND w >= 0.03 AND pt = 'N'")
def f11(t):
    rules = {"mass": ["gt", 10], "value": ["lt", 20000], "x": ["between", 100, 400], "w": ["ge", 0.03], "pt": ["eq", "N"]}
    return t.particles.where(C.restriction(rules)).select("row_index")


@query("f12_object_selection", "SELECT s.sub_id FROM subs s JOIN halos h USING (halo_id) WHERE s.mass >= 100000 AND h.m200 >= 2000000 AND s.sub_id = h.first_sub")
def f12(t):
    return t.subs.where("mass >= 100000").join(t.halos.where("m200 >= 2000000"), "halo_id").where("sub_id = first_sub").select("sub_id")


@query("f14_aperture_rules", "SELECT halo_id, pow(0.15 * r200, 2) AS r2_min, pow(r200, 2) AS r2_max, pow(least(30.0, 2 * r200), 2) AS r2_cut FROM halos")
def f14(t):
    from ..plans.catalogs import aperture_rule

    return t.halos.select("halo_id", *(aperture_rule(r).alias(n) for r, n in (("0.15 r200", "r2_min"), ("1 r200", "r2_max"), ("min(30, 2 r200)", "r2_cut"))))


@query("f15_k_correction", "SELECT p_partkey, round(0.1 + 0.2 * c + z * (0.3 - 0.05 * c) + z * z * (1.1 + 0.7 * c), 9) AS k FROM (SELECT p_partkey, p_size / 100.0 AS z, p_retailprice / 500.0 AS c FROM part) WHERE z <= 0.5")
def f15(t):
    rows = t.part.select("p_partkey", (F.col("p_size") / 100).alias("z"), (F.col("p_retailprice") / 500).alias("c")).where("z <= 0.5")
    return rows.select("p_partkey", F.round(C.polynomial2("z", "c", [[0.1, 0.2], [0.3, -0.05], [1.1, 0.7]]), 9).alias("k"))


@query("f16_packed_ids", "SELECT id, CAST((id >> 50) & 16383 AS BIGINT) AS plate, CAST((id >> 38) & 4095 AS BIGINT) AS fiber, CAST((id >> 24) & 16383 AS BIGINT) + 50000 AS mjd, CAST((id >> 10) & 16383 AS BIGINT) AS run2d FROM (SELECT l_orderkey * 1000003 * 7919 + l_partkey * 104729 AS id FROM lineitem)")
def f16(t):
    rows = t.lineitem.select(F.expr("l_orderkey * 1000003 * 7919 + l_partkey * 104729").alias("id"))
    return rows.select("id", C.bits("id", 50, 14).alias("plate"), C.bits("id", 38, 12).alias("fiber"), (C.bits("id", 24, 14) + 50000).alias("mjd"), C.bits("id", 10, 14).alias("run2d"))


@query("f17_table_interpolation", """SELECT row_index, round((f(i, j) * (1 - a) + f(i + 1, j) * a) * (1 - b) + (f(i, j + 1) * (1 - a) + f(i + 1, j + 1) * a) * b, 6) + 0.0 AS v FROM
    (SELECT row_index, u - floor(u) AS a, v - floor(v) AS b, floor(u) AS i, floor(v) AS j FROM (SELECT row_index, least(mass / 10.0, 4.9999) AS u, least(x / 250.0, 3.9999) AS v FROM particles WHERE pt = 'A'))""".replace("f(i, j)", "(i * i - 2 * j)").replace("f(i + 1, j)", "((i + 1) * (i + 1) - 2 * j)").replace("f(i, j + 1)", "(i * i - 2 * (j + 1))").replace("f(i + 1, j + 1)", "((i + 1) * (i + 1) - 2 * (j + 1))"))
def f17(t):
    table = [[i * i - 2 * j for j in range(5)] for i in range(6)]
    u, v = F.least(F.col("mass") / 10, F.lit(4.9999)), F.least(F.col("x") / 250, F.lit(3.9999))
    return t.particles.where("pt = 'A'").select("row_index", (F.round(C.on_grid_2d(u, v, list(range(6)), list(range(5)), table), 6) + F.lit(0.0)).alias("v"))


#: nodes: ten units of quantity, three hundredths of discount and of tax; the value is the mean magnitude of the rows at the node
_NODES = "(SELECT floor((l_quantity - 1) / 10) AS q, floor(round(l_discount * 100) / 3) AS d, floor(round(l_tax * 100) / 3) AS x, avg(log10(l_extendedprice)) AS v FROM lineitem GROUP BY ALL)"


def nodes(t, *more):
    rows = t.lineitem.withColumns({"q": F.floor((F.col("l_quantity") - 1) / 10), "d": F.floor(F.round(F.col("l_discount") * 100) / 3), "x": F.floor(F.round(F.col("l_tax") * 100) / 3)})
    return rows.groupBy("q", "d", "x", *more).agg(F.avg(F.log10("l_extendedprice")).alias("v"))


@query("f17b_table_3d", f"""WITH g AS {_NODES}, r AS (SELECT row_number() OVER () AS n, l_orderkey, l_linenumber, least(greatest(l_quantity / 10, 0), 4) AS a, least(greatest(l_discount * 100 / 3, 0), 3) AS b, least(greatest(l_tax * 100 / 3 - 0.25, 0), 2) AS c FROM lineitem),
    f AS (SELECT *, least(floor(a), 3) AS i, least(floor(b), 2) AS j, least(floor(c), 1) AS k FROM r)
    SELECT any_value(l_orderkey) AS l_orderkey, any_value(l_linenumber) AS l_linenumber, round(sum(v * (CASE WHEN q = i THEN 1 - (a - i) ELSE a - i END) * (CASE WHEN d = j THEN 1 - (b - j) ELSE b - j END) * (CASE WHEN x = k THEN 1 - (c - k) ELSE c - k END)), 6) AS v
    FROM f, range(2) u(di), range(2) w(dj), range(2) z(dk) JOIN g ON q = i + di AND d = j + dj AND x = k + dk GROUP BY n""")
def f17b(t):
    """Multilinear in three dimensions, rows beyond the grid at its edges."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 10).alias("a"), (F.col("l_discount") * 100 / 3).alias("b"), (F.col("l_tax") * 100 / 3 - 0.25).alias("c"))
    out = L.interpolated(rows, nodes(t), {"q": "a", "d": "b", "x": "c"}, "v", "v")
    return out.select("l_orderkey", "l_linenumber", F.round("v", 6).alias("v"))


@query("f17c_table_4d_spline")
def f17c(t):
    """A cubic spline in four dimensions: the nodes' values of each line number are a slice of the grid."""
    grid = nodes(t).withColumn("n", F.explode(F.array(*(F.lit(float(k)) for k in range(1, 8))))).withColumn("v", F.col("v") + F.sin(F.col("n") + F.col("q")))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 10).alias("a"), (F.col("l_discount") * 100 / 3).alias("b"), (F.col("l_tax") * 100 / 3).alias("c"), (F.col("l_linenumber") + F.col("l_tax")).alias("e"))
    out = L.interpolated(rows, grid, {"q": "a", "d": "b", "x": "c", "n": "e"}, "v", "v", order=3)
    return out.select("l_orderkey", "l_linenumber", F.round("v", 6).alias("v"))


_LAM = 1 - 0.3089
_AGE = 2 / (67.74 * 3 * math.sqrt(_LAM)) * (3.085678e19 / 3.15576e7 / 1e9)


@query("f18_cosmology", f"SELECT tracer_id, snap, round({_AGE!r} * asinh(pow(1 + redshift, -1.5) * {math.sqrt(_LAM / 0.3089)!r}), 6) AS age, round(redshift, 4) AS back FROM tracks JOIN snapshots USING (snap)")
def f18(t):
    age = SIM.age_gyr("redshift")
    rows = t.tracks.join(t.snapshots, "snap")
    return rows.select("tracer_id", "snap", F.round(age, 6).alias("age"), F.round(SIM.redshift_at(age), 4).alias("back"))


@query("f18b_comoving_distance")
def f18b(t):
    return t.tracks.join(t.snapshots, "snap").select("tracer_id", "snap", F.round(SIM.comoving_distance("redshift"), 4).alias("mpc"))


_SHIELD = "(0.00673 * pow(({0}) / 2.49e-18, -2.0 / 3) * pow(value / 1e4, 0.17) * pow(({1}) / 1e-12, 2.0 / 3) * pow(0.167 / 0.17, -1.0 / 3))".format("2.37e-18 + 0.5 * (2.27e-18 - 2.37e-18)", "3.03e-13 + 0.5 * (6e-13 - 3.03e-13)")


@query("f19_neutral_fraction", f"""WITH r AS (SELECT row_index, w / 10 AS n, value AS t, w / 10 / {_SHIELD} AS u, 315614.0 / value AS l FROM particles),
    c AS (SELECT row_index, n, 1.269e-13 * pow(l, 1.503) / pow(1 + pow(l / 0.522, 0.47), 1.923) AS rec, 1.17e-10 * sqrt(t) * exp(-157809.0 / t) / (1 + sqrt(t / 1e5)) AS col, (0.98 * pow(1 + pow(u, 1.64), -2.28) + 0.02 * pow(1 + u, -0.84)) * (3.03e-13 + 0.5 * (6e-13 - 3.03e-13)) AS phot FROM r),
    q AS (SELECT row_index, rec, rec + col AS a, 2 * rec + phot / n + col AS b FROM c)
    SELECT row_index, round((b - sqrt(b * b - 4 * a * rec)) / (2 * a), 6) AS neutral FROM q""")
def f19(t):
    """At redshift 1.5."""
    rows = t.particles.withColumns({"n": F.col("w") / 10, "temp": F.col("value")})
    return rows.select("row_index", F.round(SIM.neutral_fraction("n", "temp", 1.5), 6).alias("neutral"))


@query("f20_colors", "SELECT p_partkey, round(-2.5 * log10(p_retailprice) + 2.5 * log10(p_size), 6) AS color FROM part")
def f20(t):
    mag = lambda c: -2.5 * F.log10(c)
    return t.part.select("p_partkey", F.round(mag("p_retailprice") - mag("p_size"), 6).alias("color"))


@query("f21_time_interpolation", "SELECT a.tracer_id, a.snap, round(a.r + (b.r - a.r) * 0.3, 6) AS linear, round((2 * 0.027 - 3 * 0.09 + 1) * a.r + (0.027 - 2 * 0.09 + 0.3) * 2.0 * a.value / 100 + (3 * 0.09 - 2 * 0.027) * b.r + (0.027 - 0.09) * 2.0 * b.value / 100, 6) AS cubic FROM tracks a JOIN tracks b ON a.tracer_id = b.tracer_id AND b.snap = a.snap + 1")
def f21(t):
    b = t.tracks.select("tracer_id", (F.col("snap") - 1).alias("snap"), F.col("r").alias("r1"), F.col("value").alias("v1"))
    rows = t.tracks.join(b, ["tracer_id", "snap"])
    return rows.select("tracer_id", "snap", F.round(C.between_rows("r", "r1", F.lit(0.3)), 6).alias("linear"), F.round(C.hermite("r", "r1", F.col("value") / 100, F.col("v1") / 100, F.lit(0.3), F.lit(2.0)), 6).alias("cubic"))


@query("f22_rotation", f"SELECT sub_id, round(500 + {_MI('(x - 500)')} * {math.cos(math.radians(30))!r} - {_MI('(y - 500)')} * {math.sin(math.radians(30))!r}, 6) AS rx, round(500 + {_MI('(x - 500)')} * {math.sin(math.radians(30))!r} + {_MI('(y - 500)')} * {math.cos(math.radians(30))!r}, 6) AS ry, z AS rz FROM subs")
def f22(t):
    x, y, z = C.rotated("xyz", C.rotation_about("z", 30), [500, 500, 500], 1000.0)
    return t.subs.select("sub_id", F.round(x, 6).alias("rx"), F.round(y, 6).alias("ry"), F.round(z, 6).alias("rz"))


@query("f23_perspective", "SELECT sub_id, round(x * 10 / (5.0 * (z + 20)), 6) AS px, round(y * 10 / (5.0 * (z + 20)), 6) AS py, round((2000.0 + 10) / (2000.0 - 10) - (2 * 2000.0 * 10 / (2000.0 - 10)) / (z + 20), 6) AS depth FROM subs")
def f23(t):
    return t.subs.select("sub_id", *(F.round(c, 6).alias(n) for c, n in zip(C.perspective("x", "y", F.col("z") + 20, 10.0, 2000.0, 5.0), ("px", "py", "depth"))))


@query("f26_sky_coordinates", f"SELECT sub_id, round(degrees(atan((y - 500) / (x + 1000))), 6) AS ra, round(degrees(atan((z - 500) / sqrt(pow(x + 1000, 2) + pow(y - 500, 2)))), 6) AS dec, round((1 + 0.1) * (1 + ((x + 1000) * vx + (y - 500) * vy + (z - 500) * vz) / sqrt(pow(x + 1000, 2) + pow(y - 500, 2) + pow(z - 500, 2)) / 299792.458) - 1, 8) AS z_obs FROM subs")
def f26(t):
    x, y, z = F.col("x") + 1000, F.col("y") - 500, F.col("z") - 500
    r = C.magnitude(x, y, z)
    along = (x * F.col("vx") + y * F.col("vy") + z * F.col("vz")) / r
    return t.subs.select("sub_id", F.round(F.degrees(F.atan(y / x)), 6).alias("ra"), F.round(F.degrees(F.atan(z / C.magnitude(x, y))), 6).alias("dec"), F.round(1.1 * (1 + along / 299792.458) - 1, 8).alias("z_obs"))


@query("f27_nearest_in_list", "SELECT p_partkey, CAST((SELECT min_by(i, (abs(v - p_size), i)) FROM (VALUES (0, 3.0), (1, 11.0), (2, 19.0), (3, 42.0)) l(i, v)) AS INTEGER) AS place FROM part")
def f27(t):
    return t.part.select("p_partkey", A.nearest_in([3.0, 11.0, 19.0, 42.0], "p_size").alias("place"))


@query("f28_last_nonzero", "SELECT vec_id, CAST(coalesce(max(k) FILTER (e > 0.2), -1) AS INTEGER) AS place FROM pixels GROUP BY vec_id")
def f28(t):
    kept = F.transform("embedding", lambda e: F.when(e.cast("double") > 0.2, e).otherwise(F.lit(0.0)))
    return t.embeddings.select("vec_id", A.last_nonzero(kept).alias("place"))


def _tau():
    return F.transform("embedding", lambda e: F.abs(e.cast("double")))


@query("f29_equivalent_width", "SELECT vec_id, round(sum((1 - exp(-abs(CAST(e AS DOUBLE)))) * CASE WHEN k IN (0, 63) THEN 0.5 ELSE 1 END) * 0.5, 6) AS ew FROM pixels GROUP BY 1")
def f29(t):
    return t.embeddings.select("vec_id", F.round(A.equivalent_width(_tau(), 0.5), 6).alias("ew"))


@query("f30_v90", """WITH c AS (SELECT vec_id, k, sum(abs(CAST(e AS DOUBLE))) OVER (PARTITION BY vec_id ORDER BY k) AS c, sum(abs(CAST(e AS DOUBLE))) OVER (PARTITION BY vec_id) AS t FROM pixels),
    d AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY vec_id ORDER BY k), 0) AS p FROM c)
    SELECT vec_id, round(max(CASE WHEN c >= 0.95 * t AND p < 0.95 * t THEN k - 1 + (0.95 * t - p) / (c - p) END) - max(CASE WHEN c >= 0.05 * t AND p < 0.05 * t THEN k - 1 + (0.05 * t - p) / (c - p) END), 6) AS v90 FROM d GROUP BY 1""")
def f30(t):
    return t.embeddings.select("vec_id", F.round(A.v90(_tau()), 6).alias("v90"))


@query("f31_resampled_spectrum", "SELECT vec_id, CAST(k // 8 AS INTEGER) AS k, round(-ln(1 - least(avg(1 - exp(-abs(CAST(e AS DOUBLE)))), 1 - 1e-16)), 6) AS tau FROM pixels GROUP BY 1, k // 8")
def f31(t):
    return t.embeddings.select("vec_id", F.posexplode(A.resampled(_tau(), 8)).alias("k", "tau")).withColumn("tau", F.round("tau", 6))


@query("f33_velocity_window", "SELECT vec_id, CAST(count(*) AS INTEGER) AS n, round(sum(abs(CAST(e AS DOUBLE))), 6) AS total FROM pixels WHERE k BETWEEN vec_id % 64 - 5 AND vec_id % 64 + 5 GROUP BY 1")
def f33(t):
    cut = A.window_around(_tau(), F.expr("cast(vec_id % 64 as int)"), 5)
    return t.embeddings.select("vec_id", F.size(cut).alias("n"), F.round(A.sum_of(cut), 6).alias("total"))


@query("f34_closed_forms", "SELECT s_suppkey, round((0.25 + 0.75 / (1 + pow(s_acctbal / 1e6 / 0.002, 2.0))) * (3.6 * 0.0118), 8) AS wind FROM supplier")
def f34(t):
    return t.supplier.select("s_suppkey", F.round(SIM.wind_energy(F.col("s_acctbal") / 1e6), 8).alias("wind"))


@query("f32_variable_convolution", """WITH g AS (SELECT k, d, exp(-0.5 * pow(d / (0.5 + k / 40.0), 2)) AS w FROM range(64) a(k), range(-4, 5) b(d)), n AS (SELECT k, sum(w) AS total FROM g GROUP BY 1)
    SELECT vec_id, CAST(p.k + d AS INTEGER) AS k, round(sum(abs(CAST(e AS DOUBLE)) * w / total), 6) AS tau FROM pixels p JOIN g ON p.k = g.k JOIN n ON p.k = n.k WHERE p.k + d BETWEEN 0 AND 63 GROUP BY ALL""")
def f32(t):
    """Each pixel is spread over its neighbours by a Gaussian that widens along the spectrum; cut at the ends."""
    half = 4
    kernel = F.array(*(F.array(*(F.lit(math.exp(-0.5 * (d / (0.5 + k / 40)) ** 2)) for d in range(-half, half + 1))) for k in range(64)))
    pixels = t.embeddings.select("vec_id", F.posexplode(_tau()).alias("k", "tau")).withColumn("d", F.explode(F.sequence(F.lit(-half), F.lit(half))))
    share = kernel[F.col("k")][F.col("d") + half] / A.sum_of(kernel[F.col("k")])
    out = pixels.select("vec_id", (F.col("k") + F.col("d")).alias("k"), (F.col("tau") * share).alias("v")).where("k between 0 and 63")
    return out.groupBy("vec_id", "k").agg(F.round(F.sum("v"), 6).alias("tau"))


