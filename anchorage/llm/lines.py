r"""Line dedup against levelled sorted runs of line hashes.

A run holds the keys that one batch brought first, bucketed and sorted by their 128-bit hash, with the id
of the owning document.  A batch of documents merge-joins the runs, newest level first: keys that no run
has are its own new run; lines whose key belongs to an earlier document are dropped.  When a level has
``fanout`` runs they are merged into one of the next level, so n batches leave about fanout * log(n) runs.

A line's key is the line without ``[\x20\x09-\x0D]`` at its ends and with A-Z in lower case; keys of fewer
than ``min_chars`` code points are never dropped.  Batches are taken in the order of ids, so the owner is
the smallest id that holds the line.

Defined results: a null or empty text is one empty line.  Lines repeated within their owner stay.  Rows
with the same id count as one document; rows with a null id own nothing and lose nothing.  Extra columns
are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import spread_join
from ..operators.staging import delete, new_folder
from .runs import BucketedTable, default_buckets, stage

BLANKS = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ["h1", "h2"]


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z in lower case and nothing else changed."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _LOWER)
    )


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


class LineRuns:
    """The keys of all lines seen so far: ``levels[i]`` are the runs of level i, oldest first."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, fanout: int = 3, id_type: str = "bigint"):
        self.spark, self.path, self.buckets, self.fanout, self.id_type = spark, path, buckets, fanout, id_type
        self.levels: list[list[BucketedTable]] = []
        self._made = 0

    def _write(self, level: int, rows: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self._made += 1
        run = BucketedTable(
            self.spark, f"{self.path}/level{level}-run{self._made}", f"h1 BIGINT, h2 BIGINT, owner {self.id_type}", _KEY, self.buckets
        )
        run.append(rows)
        self.levels[level].append(run)

    def owners(self, keys: DataFrame) -> DataFrame:
        """``keys`` with the ``owner`` that some run has for the key, else NULL; the runs are not shuffled."""
        names = []
        for run in [run for level in self.levels for run in level]:
            names.append(f"_owner{len(names)}")
            keys = keys.join(run.read().withColumnRenamed("owner", names[-1]).hint("merge"), _KEY, "left")
        owner = F.coalesce(*names) if names else F.lit(None).cast(self.id_type)
        return keys.withColumn("owner", owner).drop(*names)

    def add(self, rows: DataFrame) -> None:
        """Add new keys as a run, and compact every level that has become full."""
        self._write(0, rows)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self.levels[level], []
            self._write(level + 1, reduce(DataFrame.unionByName, [run.read() for run in merged]))
            for run in merged:
                delete(self.spark, run.path)
            level += 1


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """``id, pos, h1, h2`` of every line whose key is long enough."""
    line = F.trim(F.col("_line"), F.lit(BLANKS))
    return (
        docs.select(F.col(id_col).alias("id"), F.posexplode(_lines(lower_ascii(F.col(text_col)))).alias("pos", "_line"))
        .select("id", "pos", line.alias("_key"))
        .filter((F.char_length("_key") >= min_chars) & F.col("id").isNotNull())
        .select("id", "pos", F.xxhash64("_key").alias("h1"), F.xxhash64(F.lit(1), "_key").alias("h2"))
    )


def repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 3
) -> DataFrame:
    """``id, dropped`` (array of line numbers from 0) of the documents that lose lines."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    cuts = docs.agg(F.percentile_approx(id_col, [i / batches for i in range(1, batches)])).first()[0] or []
    batch = reduce(lambda n, cut: n + (F.col("id") > cut).cast("int"), sorted(set(cuts)), F.lit(0))
    lines = stage(line_keys(docs, id_col, text_col, min_chars).withColumn("batch", batch), "lines")
    runs = LineRuns(spark, new_folder(spark, "line-runs"), default_buckets(spark), fanout, id_type)
    drops = []
    for i in range(len(set(cuts)) + 1):
        here = lines.filter(F.col("batch") == i)
        keys = here.groupBy(*_KEY).agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n"))
        judged = stage(runs.owners(keys), "keys")
        runs.add(judged.filter(F.col("owner").isNull()).select(*_KEY, F.col("low").alias("owner")))
        repeated = judged.withColumn("owner", F.coalesce("owner", "low")).filter(F.col("high") > F.col("owner"))
        found = spread_join(here, repeated.select(*_KEY, "owner"), _KEY, repeated, "n", ["id", "pos"])
        drops.append(found.filter(F.col("id") > F.col("owner")).select("id", "pos"))
    return reduce(DataFrame.unionByName, drops).groupBy("id").agg(F.collect_set("pos").alias("dropped"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``id, n_lines, n_dropped, kept_text``, one row per row of ``docs``."""
    drops = repeated_lines(docs, id_col, text_col, **options).withColumnRenamed("id", "_of")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = _lines(F.col("text"))
    # positions are integers, for which array_except hashes: linear in the number of lines
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped"))
    kept = F.array_join(F.transform(left, lambda p: F.get(F.col("_lines"), p)), "\n")
    return (
        texts.join(drops.hint("shuffle_hash"), F.col("id") == F.col("_of"), "left")
        .withColumn("_lines", lines)
        .select(
            "id",
            F.size("_lines").cast("bigint").alias("n_lines"),
            F.coalesce(F.size("dropped"), F.lit(0)).cast("bigint").alias("n_dropped"),
            F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
        )
    )
