"""Report lines ``path:line: TAG link`` as a source of link records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.staging import stage
from ..schemas import REJECTS, REPORT_RECORDS, conform

# Fixed value: the report line format.  (?d): only \n ends a line.
RECORD_PATTERN = r"(?d)^(.*):(\d+): [^ ]* ([^ ]*)\z"
# Fixed value: the reason of a malformed line.
MALFORMED = "invalid record format"


def read_report(spark: SparkSession, location: str | list[str]) -> DataFrame:
    """Lines of report files: ``line``, ``source`` (the file), ``line_no`` (from 1 in the file) and ``rank`` (from 1 in all files).

    Files count in the order of their names.  They are read in blocks by many tasks and staged with the place of
    every line in its task, where the lines of a block follow each other; so numbers need only the lines counted
    per block and summed over the blocks in front.  That sum is the one step in a single task, over one row a block.
    """
    # only \n ends a line; one \r before it belongs to the end
    read = spark.read.option("lineSep", "\n").text(location).select(
        F.regexp_replace("value", r"\r\z", "").alias("line"),
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
    )
    lines = stage(read, "report-lines")
    blocks = lines.groupBy("source", "block").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    in_front = Window.orderBy("source", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(in_front), F.lit(0).cast("bigint")))
    blocks = blocks.withColumn("files_before", F.min("before").over(Window.partitionBy("source"))).drop("n")
    rank = F.col("before") + F.col("place") - F.col("first") + 1
    numbered = lines.join(blocks, ["source", "block"]).withColumn("rank", rank)
    return numbered.select("line", "source", (F.col("rank") - F.col("files_before")).alias("line_no"), "rank")


def _fits(line: Column) -> Column:
    # a line number has to fit the BIGINT column
    return line.rlike(RECORD_PATTERN) & F.regexp_extract(line, RECORD_PATTERN, 2).try_cast("bigint").isNotNull()


def _ordered(lines: DataFrame) -> DataFrame:
    have = set(lines.columns)
    order = F.col("doc_ord") if "doc_ord" in have else (F.col("line_no") if "line_no" in have else F.lit(None))
    return lines.withColumn("doc_ord", order.cast("bigint"))


def parse_records(lines: DataFrame) -> DataFrame:
    """Link records of the well-formed lines (column ``line``; ``line_no`` or ``doc_ord`` for the order).

    Line numbers are BIGINT, as a report may come from elsewhere; those of extracted links are INT.
    """
    line = F.col("line")
    return conform(
        _ordered(lines).filter(_fits(line)).withColumns(
            {
                "doc_path": F.regexp_extract(line, RECORD_PATTERN, 1),
                "doc_line": F.regexp_extract(line, RECORD_PATTERN, 2).cast("bigint"),
                "link": F.regexp_extract(line, RECORD_PATTERN, 3),
                "pos": F.lit(0),
            }
        ),
        REPORT_RECORDS,
    )


def malformed_lines(lines: DataFrame) -> DataFrame:
    """The other lines, with their number where the input has one (rejects schema)."""
    line = F.col("line")
    return conform(
        lines.filter(~_fits(line) | line.isNull()).withColumns(
            {"value": line, "reason": F.lit(MALFORMED)}
        ),
        REJECTS,
    )
