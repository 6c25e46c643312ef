"""The driver compiles the passes of the rates' fit once, not for every pass."""

from pyspark.sql import functions as F

from skyframe.llm.mixing import settled


def test_settled_compiles_once(spark, tmp_path):
    rows = [(i % 50 + 1, [0.1 + 0.08 * (i * 7 % 10), 0.1, 0.8 - 0.08 * (i * 7 % 10)]) for i in range(500)]
    spark.createDataFrame(rows, "tokens long, p array<double>").write.parquet(str(tmp_path / "m"))
    members = spark.read.parquet(str(tmp_path / "m"))
    base = [float(x) for x in members.agg(*(F.sum(F.col("tokens") * F.col("p")[d]) for d in range(3))).first()]
    compiled = spark.sparkContext._jvm.org.apache.spark.metrics.source.CodegenMetrics.METRIC_COMPILATION_TIME().getCount
    before, passes = compiled(), []
    aim = [0.85 * sum(base), 0.15 * sum(base), 0.0]
    seen = type(members).agg
    try:
        type(members).agg = lambda self, *a: passes.append(1) or seen(self, *a)
        settled(members, aim, base, [1e-8, 1e-8, 1e-4])
    finally:
        type(members).agg = seen
    assert len(passes) > 15
    assert compiled() - before < 10
