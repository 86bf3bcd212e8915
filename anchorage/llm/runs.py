"""Parquet folders bucketed and sorted by a key, so that joins on the key read them without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators import staging


def default_buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """As ``staging.stage``, for jobs of many steps over large tables.

    The shuffle files of a step go once the driver's JVM collects its plan; it is asked to, or the disks
    would keep the shuffles of all steps.
    """
    staged = staging.stage(df, name, **options)
    df.sparkSession._jvm.System.gc()
    return staged


class BucketedTable:
    """Rows at ``path``, bucketed and sorted by ``keys``.

    The files carry the bucket number in their names, so another session opens the folder by giving the
    same path, columns and number of buckets.
    """

    def __init__(self, spark: SparkSession, path: str, columns: str, keys: list[str], buckets: int):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets
        self.name = f"sorted_{uuid.uuid4().hex}"
        by = ", ".join(keys)
        spark.sql(
            f"CREATE TABLE {self.name} ({columns}) USING parquet "
            f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def append(self, rows: DataFrame) -> None:
        """Add rows: each task writes the buckets that it holds, sorted."""
        rows.repartition(self.buckets, *self.keys).select(self.spark.table(self.name).columns).write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def drop(self) -> None:
        """Forget the table and delete its files, once nothing reads it any more."""
        self.spark.sql(f"DROP TABLE {self.name}")
        staging.delete(self.spark, self.path)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)
