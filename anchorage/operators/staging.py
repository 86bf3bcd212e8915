"""Materialize a frame once, in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  Where it is unset, a local session gets a folder of its own; a cluster is refused."""
    root = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not is_local(spark):
            raise ValueError(f"set {_SETTING} to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="anchorage-")
        spark.conf.set(_SETTING, root)
    return root.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _file_system(spark, path)
    return files.exists(where)


def size(spark: SparkSession, path: str) -> int:
    """The bytes of a file, or of all files below a folder."""
    files, where = _file_system(spark, path)
    return files.getContentSummary(where).getLength()


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Have the session's JVM delete ``path`` when it ends: results that read it are lazy and may run until then."""
    files, where = _file_system(spark, path)
    files.deleteOnExit(where)


def delete(spark: SparkSession, path: str) -> None:
    files, where = _file_system(spark, path)
    files.delete(where, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a fresh folder below the shared one; it goes when the session ends."""
    path = f"{shared_folder(spark)}/anchorage-{uuid.uuid4().hex}/{name}"
    _open_scopes[-1].append(path) if _open_scopes else None
    delete_at_exit(spark, path.rsplit("/", 1)[0])
    return path


_open_scopes: list[list[str]] = []


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Delete what is staged inside the block at its end, for callers that have written their result by then."""
    _open_scopes.append([])
    try:
        yield
    finally:
        for path in _open_scopes.pop():
            delete(spark, path.rsplit("/", 1)[0])


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet (with the writer's ``options``) below ``spark.checkpoint.dir`` and read it back.

    Unlike a cached frame it survives the loss of executors, and unlike a checkpoint it is columnar:
    each later step reads only its own columns.  The files go at the end of a ``staging`` block, or
    else with the session.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
