"""Report lines that keep arriving, as from a pipe: each micro-batch is checked as one report."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.check import check_links, stage_index
from ..sources.reports import malformed_lines, parse_records


def read_report_stream(spark: SparkSession, location: str) -> DataFrame:
    """Lines of report files as they appear in a folder (columns ``line`` and ``source``, the file)."""
    return spark.readStream.option("lineSep", "\n").text(location).select(
        F.regexp_replace("value", r"\r\z", "").alias("line"), F.col("_metadata.file_path").alias("source")
    )


def check_report_stream(
    lines: DataFrame,
    documents: DataFrame,
    responses: DataFrame | None,
    location: str,
    checkpoint: str,
    trigger: dict[str, Any] | None = None,
    **options: Any,
) -> StreamingQuery:
    """Check the links of every batch and write them as Parquet to ``location/checked/batch=<n>``.

    Malformed lines and unparsable links go to ``location/rejects/batch=<n>``.  The documents are parsed
    once, when the stream starts; what becomes of them later is not seen until it starts again.
    Checking a link needs nothing of other batches, so no state is kept.  A batch that is run again
    after a failure replaces its own folder, so every line is checked exactly once.
    """

    root = options.get("root")
    index = stage_index(documents, root, **{k: v for k, v in options.items() if k == "slug"})

    def check(batch: DataFrame, number: int) -> None:
        # within the batch rows differ by their order, which also spreads the links of a hot target
        numbered = batch.withColumn("doc_ord", F.monotonically_increasing_id())
        checked, rejects = check_links(None, responses, records=parse_records(numbered), index=index, **options)
        checked.write.mode("overwrite").parquet(f"{location}/checked/batch={number}")
        rejects.unionByName(malformed_lines(numbered)).write.mode("overwrite").parquet(f"{location}/rejects/batch={number}")

    return (
        lines.writeStream.foreachBatch(check)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
