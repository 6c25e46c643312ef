"""The test tables in the roles of particles, objects, tracks and spectra, as DataFrames and as SQL for the checks."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import row_index

BOX = 1000.0

SQL = {
    "particles": """SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_tax) - 1 AS row_index, l_orderkey AS sub_id, o_custkey AS halo_id,
        l_returnflag AS pt, l_quantity AS mass, l_extendedprice AS value, l_tax + 0.01 AS w,
        CAST((l_partkey * 37 + l_linenumber * 101) % 1000 AS DOUBLE) AS x, CAST((l_suppkey * 53 + l_partkey * 11) % 1000 AS DOUBLE) AS y,
        CAST((l_orderkey * 7 + l_linenumber * 29) % 1000 AS DOUBLE) AS z, CAST(l_partkey % 401 - 200 AS DOUBLE) AS vx,
        CAST(l_suppkey % 37 - 18 AS DOUBLE) AS vy, CAST(l_linenumber * 10 - 30 AS DOUBLE) AS vz
        FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""",
    "subs": """SELECT o_orderkey AS sub_id, o_custkey AS halo_id, o_totalprice AS mass, CAST((o_orderkey * 37) % 1000 AS DOUBLE) AS x,
        CAST((o_orderkey * 91 + o_custkey * 13) % 1000 AS DOUBLE) AS y, CAST((o_custkey * 57 + o_orderkey * 3) % 1000 AS DOUBLE) AS z,
        CAST(o_orderkey % 201 - 100 AS DOUBLE) AS vx, CAST(o_custkey % 101 - 50 AS DOUBLE) AS vy, CAST(o_orderkey % 51 - 25 AS DOUBLE) AS vz, o_orderpriority AS class FROM orders""",
    "halos": """SELECT halo_id, min(sub_id) AS first_sub, count(*) AS n_subs, sum(mass) AS m200, CAST(20 + halo_id % 30 AS DOUBLE) AS r200 FROM subs GROUP BY halo_id""",
    "tracks": """SELECT user_id AS tracer_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS snap, round(avg(value) / 50, 6) AS r,
        max(value) AS value, min(event_type) AS kind, count(*) AS n FROM events GROUP BY ALL""",
    "snapshots": """SELECT CAST(s AS INTEGER) AS snap, (29 - s) / 10.0 AS redshift FROM range(30) t(s)""",
    "lens": """SELECT sub_id, min(halo_id) AS halo_id, count(*) AS len, min(row_index) AS start FROM particles GROUP BY sub_id""",
    "pixels": """SELECT vec_id, label, unnest(range(64)) AS k, unnest(embedding) AS e FROM embeddings""",
}


def with_roles(sql: str) -> str:
    """Puts the roles that a query names before it."""
    names, todo = [], [sql]
    while todo:
        text = todo.pop()
        for name in SQL:
            if re.search(rf"\b{name}\b", text):
                if name in names:
                    names.remove(name)
                names.insert(0, name)
                todo.append(SQL[name])
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    body = sql.strip()
    if not head:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def rows(self) -> DataFrame:
        """Particles without their row index, for what does not need the global order."""
        d = lambda e: F.expr(e).cast("double")
        owners = self.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("halo_id"))
        return self.lineitem.join(owners, "l_orderkey", "left").select(
            F.col("l_orderkey").alias("sub_id"), "halo_id", F.col("l_returnflag").alias("pt"), F.col("l_quantity").alias("mass"), F.col("l_extendedprice").alias("value"), (F.col("l_tax") + 0.01).alias("w"),
            d("(l_partkey * 37 + l_linenumber * 101) % 1000").alias("x"), d("(l_suppkey * 53 + l_partkey * 11) % 1000").alias("y"), d("(l_orderkey * 7 + l_linenumber * 29) % 1000").alias("z"),
            d("l_partkey % 401 - 200").alias("vx"), d("l_suppkey % 37 - 18").alias("vy"), d("l_linenumber * 10 - 30").alias("vz"), "l_linenumber", "l_partkey", "l_suppkey",
        )

    @cached_property
    def particles(self) -> DataFrame:
        order = ["sub_id", "l_linenumber", "l_partkey", "l_suppkey", "value", "mass", "w"]
        return row_index(self.rows, order, F.floor(F.col("sub_id") / 4096)).drop(*order[1:4])

    @cached_property
    def subs(self) -> DataFrame:
        d = lambda e: F.expr(e).cast("double")
        return self.orders.select(
            F.col("o_orderkey").alias("sub_id"), F.col("o_custkey").alias("halo_id"), F.col("o_totalprice").alias("mass"),
            d("(o_orderkey * 37) % 1000").alias("x"), d("(o_orderkey * 91 + o_custkey * 13) % 1000").alias("y"), d("(o_custkey * 57 + o_orderkey * 3) % 1000").alias("z"),
            d("o_orderkey % 201 - 100").alias("vx"), d("o_custkey % 101 - 50").alias("vy"), d("o_orderkey % 51 - 25").alias("vz"), F.col("o_orderpriority").alias("class"),
        )

    @cached_property
    def halos(self) -> DataFrame:
        out = self.subs.groupBy("halo_id").agg(F.min("sub_id").alias("first_sub"), F.count(F.lit(1)).alias("n_subs"), F.sum("mass").alias("m200"))
        return out.withColumn("r200", F.expr("cast(20 + halo_id % 30 as double)"))

    @cached_property
    def tracks(self) -> DataFrame:
        snap = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("snap")
        return self.events.groupBy(F.col("user_id").alias("tracer_id"), snap).agg(
            F.round(F.avg("value") / 50, 6).alias("r"), F.max("value").alias("value"), F.min("event_type").alias("kind"), F.count(F.lit(1)).alias("n"))

    @cached_property
    def snapshots(self) -> DataFrame:
        return self.spark.range(30).select(F.col("id").cast("int").alias("snap"), ((29 - F.col("id")) / 10.0).alias("redshift"))

    @cached_property
    def lens(self) -> DataFrame:
        return self.particles.groupBy("sub_id").agg(F.min("halo_id").alias("halo_id"), F.count(F.lit(1)).alias("len"), F.min("row_index").alias("start"))

    @cached_property
    def pixels(self) -> DataFrame:
        return self.embeddings.select("vec_id", "label", F.posexplode("embedding").alias("k", "e"))


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of Tables as a query, with the SQL that checks it."""

    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = with_roles(sql)
        return f

    return keep
