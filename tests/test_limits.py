"""Values that lie exactly on a limit, where double sums and differences miss it, against the queries' own SQL."""

import datetime
import threading

import duckdb
import pytest
from pyspark.sql import functions as F

from skyframe.plans import roles
from skyframe.queries import load_all

load_all()


def both(spark, path, name):
    """The query's rows and its SQL's, sorted."""
    con = duckdb.connect()
    for f in path.iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}/*.parquet'")
    want = con.execute(roles.ORACLES[name])
    names = [d[0] for d in want.description]
    return sorted(map(tuple, roles.QUERIES[name](spark, str(path)).select(names).collect()), key=repr), sorted(want.fetchall(), key=repr)


def events(spark, path):
    """Tracks that reach a boundary exactly at each of 30 snapshots, from below and from above."""
    rows = []
    for snap in range(1, 30):
        for k, level in enumerate((60, 100)):
            for j, (a, b) in enumerate(((level - 30, level + snap), (level + 60, level + snap))):
                at = datetime.datetime(2024, 1, 1, 12) + datetime.timedelta(days=snap)
                user = snap * 4 + k * 2 + j
                rows += [(len(rows), at - datetime.timedelta(days=1), user, "click", a / 2), (len(rows) + 1, at, user, "click", b / 2)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(str(path / "events.parquet"))


@pytest.mark.parametrize("name", ["a98_boundary_crossings", "a98b_crossing_events"])
def test_tracks_that_touch_a_boundary(spark, tmp_path, name):
    events(spark, tmp_path)
    got, want = both(spark, tmp_path, name)
    assert got == want and got


def test_items_exactly_at_a_limit(spark, tmp_path):
    """An item may be a balance less 7000 to the cent, though the difference of the two is not 7000."""
    balances = [round(-900 + 37.31 * k, 2) for k in range(100)]
    items = [round(b + g, 2) for b in balances for g in (-7000, 7000, -500, 0)]
    spark.createDataFrame([(k, 1, b) for k, b in enumerate(balances)], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(k, 1, b) for k, b in enumerate(items)], "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    got, want = both(spark, tmp_path, "j32b_matched_realisations")
    assert got == want and got


def test_five_neighbours_at_the_very_place(spark, tmp_path):
    """They take no volume, and the density is infinite, as in the SQL."""
    rows = [(1000 * k, 1000 * k, 1e5, "1-URGENT") for k in range(8)] + [(7 * k + 1, 3 * k, 1e5, "1-URGENT") for k in range(60)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    got, want = both(spark, tmp_path, "a60_nth_overdensity")
    assert got == want and sum(r[1] == float("inf") for r in got) == 8


def test_nearest_of_many_items(spark, tmp_path):
    """Ties, limits and empty ranges; no pairs of the rows are made, of which there would be 4 thousand million."""
    from skyframe.operators import matching

    nations = spark.range(400).select(F.col("id").alias("s_suppkey"), F.expr("cast(id % 3 as int)").alias("s_nationkey"), F.expr("round(id * 37.31D % 9000 - 900, 2)").alias("s_acctbal"))
    nations.write.parquet(str(tmp_path / "supplier.parquet"))
    items = spark.range(150).select(F.col("id").alias("c_custkey"), F.expr("cast(id % 2 as int)").alias("c_nationkey"), F.expr("round(id * id * 1.17D % 6000, 2)").alias("c_acctbal"))
    items.union(items.selectExpr("c_custkey + 500", "c_nationkey", "c_acctbal")).write.parquet(str(tmp_path / "customer.parquet"))
    got, want = both(spark, tmp_path, "j32_constrained_nearest")
    assert got == want and got
    rows = spark.range(65_536).select("id", F.lit(1).alias("k"), (F.col("id") % 4096).cast("double").alias("v"))
    timer = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    timer.start()
    got = matching.nearest_value(rows, rows.select(F.col("id").alias("item"), "k", "v"), ["k"], "v", "id", "item").agg(F.count(F.lit(1)), F.max("distance"), F.max("item")).first()
    timer.cancel()
    assert tuple(got) == (65_536, 0.0, 4095)
