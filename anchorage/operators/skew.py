"""Left joins that fan one row out to many, with very unevenly used keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_SHARES = 1000
ROWS_PER_TASK = 1_000_000


def hot_keys(counts: DataFrame, keys: list[str], n: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Every key with more rows than one task should get, with its number of splits.

    The threshold is ``rows_per_task`` or 1/``MAX_SHARES`` of all rows, whichever is more.  At most
    ``MAX_SHARES`` keys can exceed such a share, whatever the data, so the list may be broadcast; none is
    left out.  A share of a thousandth is no more than a task's part when there are a thousand tasks.
    """
    share = F.greatest(counts.agg(F.coalesce(F.sum(n), F.lit(0)) / MAX_SHARES).scalar(), F.lit(rows_per_task))
    return (
        counts.withColumn("_share", share)
        .filter(F.col(n) > F.col("_share"))
        .select(*keys, F.ceil(F.col(n) / F.col("_share")).cast("int").alias("_splits"))
    )


def spread_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    counts: DataFrame,
    n: str,
    spread: list[str],
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """``left`` LEFT JOIN ``right`` (unique on ``keys``), splitting the keys that are hot on the left.

    Rows of a hot key get one of its split numbers by a hash of the ``spread`` columns (so a retried
    task gives the same number); the one matching row on the right is repeated once per split.
    """
    hot = F.broadcast(hot_keys(counts, keys, n, rows_per_task))
    salted_left = (
        left.join(hot, keys, "left")
        .withColumn(
            "_salt",
            F.when(
                F.col("_splits").isNotNull(),
                F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.col("_splits").cast("bigint")).cast("int"),
            ).otherwise(F.lit(0)),
        )
        .drop("_splits")
    )
    salted_right = (
        right.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_splits", F.lit(1)) - 1)))
        .drop("_splits")
    )
    return salted_left.join(salted_right, [*keys, "_salt"], "left").drop("_salt")
