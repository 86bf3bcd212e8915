"""Markdown documents: from files or from any table with a path and a text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DOCUMENTS, REJECTS, conform


def documents_from_table(
    df: DataFrame, path: str = "path", text: str = "text", doc_ord: str | None = None
) -> DataFrame:
    """Documents out of a table, one row per document; the other columns are not read."""
    have = set(df.columns)
    return conform(
        df.select(
            F.col(path).alias("path"),
            F.col(text).alias("text"),
            *([F.col(doc_ord).alias("doc_ord")] if doc_ord else []),
            *[F.col(c) for c in ("is_dir", "io_error") if c in have],
        ),
        DOCUMENTS,
    ).withColumn("is_dir", F.coalesce("is_dir", F.lit(False)))


def _is_there(spark: SparkSession, location: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(location)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def read_documents(
    spark: SparkSession, location: str | list[str], base: str | None = None, glob: str | None = None
) -> DataFrame:
    """Files as documents, each whole.  ``base`` is cut off the front of the paths.

    Folders are read recursively.  A text that is not UTF-8 is kept as it is: as a source it is
    rejected, as the target of a link it is decoded leniently.  A location that does not exist is a
    document without text, ``io_error`` NOT_FOUND, and does not stop the others.
    """
    locations = [location] if isinstance(location, str) else list(location)
    there = [x for x in locations if _is_there(spark, x)]
    missing = [x for x in locations if x not in there]
    path = F.regexp_replace(F.col("path"), "^file:/+", "/")
    if base:
        prefix = base.rstrip("/") + "/"
        path = F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(path)
    lost = spark.createDataFrame([(x,) for x in missing], "path string").select(
        path.alias("path"), F.lit(False).alias("is_dir"), F.lit("NOT_FOUND").alias("io_error")
    )
    if not there:
        return conform(lost, DOCUMENTS)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    read = reader.load(there).select(
        path.alias("path"), F.col("content").cast("string").alias("text"), F.lit(False).alias("is_dir")
    )
    return conform(read, DOCUMENTS).unionByName(conform(lost, DOCUMENTS)) if missing else conform(read, DOCUMENTS)


def union_documents(*parts: DataFrame) -> DataFrame:
    """Several document sources after each other."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def unreadable_documents(documents: DataFrame) -> DataFrame:
    """Documents that contribute no links, with the reason (rejects schema)."""
    reason = (
        F.when(F.coalesce("is_dir", F.lit(False)), F.lit("IS_DIR"))
        .when(F.col("io_error").isNotNull() | F.col("text").isNull(), F.coalesce("io_error", F.lit("NO_TEXT")))
        .when(~F.is_valid_utf8("text"), F.lit("NOT_UTF8"))
    )
    return conform(
        documents.select(F.col("path").alias("source"), F.col("path").alias("value"), reason.alias("reason"))
        .filter(F.col("reason").isNotNull()),
        REJECTS,
    )
