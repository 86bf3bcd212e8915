"""What parsing costs: sums that are computed once, and rows that are dealt to enough tasks."""

from pyspark.sql import functions as F

from anchorage.functions.arrays import running_max, running_sum
from workloads import fixtures


def _marked(x, _):
    return F.when(x > 0, F.abs(x)).otherwise(x)


def test_running_sums_and_maxima_compute_their_values_once(spark):
    rows = spark.createDataFrame([([],), ([3],), ([1, -2, 5, None, 4],), (list(range(70)),)], "x array<int>")
    for scan in (running_sum, running_max):
        plan = rows.select(scan(F.col("x"), _marked).alias("s"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("abs(") == 1
    clean = rows.select(F.filter("x", lambda v: v.isNotNull()).alias("x"))
    found = clean.select("x", running_sum(F.col("x"), lambda v, _: v).alias("s")).collect()
    assert all(r["s"] == [sum(r["x"][: i + 1]) for i in range(len(r["x"]))] for r in found)
    most = rows.select("x", running_max(F.col("x"), lambda v, _: v).alias("m")).collect()
    for r in most:
        assert r["m"] == [max([v for v in r["x"][: i + 1] if v is not None], default=None) for i in range(len(r["x"]))]


def test_small_files_are_dealt_to_more_tasks(spark, tmp_path):
    rows = spark.range(0, 60_000, 1, 1).selectExpr("CASE WHEN id % 3 = 0 THEN null ELSE id % 7 END AS k", "uuid() AS text")
    rows.coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    read, plain = fixtures.table(spark, str(tmp_path), "t"), spark.read.parquet(str(tmp_path / "t.parquet"))
    sizes = read.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 2 * 60_000 / len(sizes)
    assert read.exceptAll(plain).isEmpty() and plain.exceptAll(read).isEmpty()
