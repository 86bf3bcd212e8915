"""Exact dedup against a persistent digest index.

The index holds one row per distinct text: its SHA-256, the id of the document that stays, and the batch
that brought it.  It is bucketed and sorted by digest, so new data meets it in a sort-merge anti-join that
moves only the new digests, and what is new is appended.

Defined results: a null text counts as empty, and all empty texts are equal.  Of equal texts within a
batch the largest id stays; a text that an earlier batch brought is dropped in every later one.  Rows
that repeat id and text stay or go together.  A null id is smaller than every other; where all ids of a
text are null, its rows stay.  Extra columns are ignored by ``add`` and kept by ``keep_distinct``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import ROWS_PER_TASK, spread_join
from ..operators.staging import exists, new_folder
from .columns import without_ids
from .runs import BucketedTable, default_buckets, stage


_DIGEST = "sha256"


class DigestIndex:
    """The index below ``path``: its rows, and beside them the layout they were written with.

    ``buckets`` and ``id_type`` are for a new index.  One that exists keeps its number of buckets, whatever the
    session is set to, and is refused where the ids are of another type.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, id_type: str = "bigint"):
        layout = f"{path}/layout"
        if exists(spark, f"{layout}/_SUCCESS"):
            written = spark.read.schema("buckets INT, id_type STRING, digest STRING").json(layout).first()
            if (written.id_type, written.digest) != (id_type, _DIGEST):
                raise ValueError(f"{path} has {written.digest} digests and ids of type {written.id_type}, not {_DIGEST} and {id_type}")
            buckets = written.buckets
        else:
            buckets = buckets or default_buckets(spark)
            made = spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(id_type).alias("id_type"), F.lit(_DIGEST).alias("digest"))
            made.write.mode("overwrite").json(layout)
        self.table = BucketedTable(spark, f"{path}/rows", f"digest BINARY, keep_id {id_type}, batch STRING", ["digest"], buckets)

    def add(
        self, batch: DataFrame, batch_id: str, id_col: str = "doc_id", text_col: str = "text", rows_per_task: int = ROWS_PER_TASK
    ) -> DataFrame:
        """Deduplicate ``batch`` against the index and itself, and append its new digests.

        One row per row of ``batch``: ``id, digest, keep_id, group_size, kept``; ``group_size`` counts the
        equal texts of the batch.  Adding a batch again under its own id gives the same result, so a job
        that failed half-way is simply repeated.
        """
        digests = stage(
            batch.select(
                F.col(id_col).alias("id"),
                F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"),
            ),
            "digests",
        )
        # pre-aggregated per map task: a text with a third of all rows is one row per task
        counts = stage(
            digests.groupBy("digest").agg(F.max("id").alias("newest"), F.count(F.lit(1)).alias("group_size")), "counts"
        )
        fresh = counts.join(self.table.read().hint("merge"), "digest", "left_anti")
        self.table.append(fresh.select("digest", F.col("newest").alias("keep_id"), F.lit(batch_id).alias("batch")))
        owners = counts.join(self.table.read().hint("merge"), "digest").select("digest", "keep_id", "batch", "group_size")
        joined = spread_join(digests, owners, ["digest"], counts, "group_size", ["id"], rows_per_task)
        return joined.select(
            "id",
            "digest",
            "keep_id",
            "group_size",
            ((F.col("batch") == batch_id) & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``DigestIndex.add`` for ``docs`` as the first batch of a new index."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    index = DigestIndex(spark, new_folder(spark, "digest-index"), id_type=id_type)
    return index.add(docs, "first", id_col, text_col, **options)


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_duplicates`` drops."""
    return without_ids(docs, id_col, exact_duplicates(docs, id_col, text_col).filter(~F.col("kept")).select("id"))
