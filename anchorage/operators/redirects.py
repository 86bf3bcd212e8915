"""Redirect chains over a table of responses, by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import ROWS_PER_TASK, spread_join
from .staging import stage

MAX_HOPS = 10


def redirect_edges(index: DataFrame) -> DataFrame:
    """``(url, hops, end)`` for the responses that redirect, with the one hop they state."""
    hop = F.struct(F.col("status").alias("status"), F.col("next_url").alias("url"))
    return index.filter(F.col("next_url").isNotNull()).select(
        "url", F.array(hop).alias("hops"), F.col("next_url").alias("end")
    )


def resolve_redirects(
    index: DataFrame, max_hops: int = MAX_HOPS, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """``(url, hops, end)`` with the whole chain of every redirecting response of an index.

    Each round appends to every chain the chain that starts at its end, so lengths double and
    ``log2(max_hops)`` rounds are enough.  A chain longer than ``max_hops`` is too long, and so is a
    loop, whose chain keeps growing.  Rounds are staged, which keeps the plan small, and stop as
    soon as no chain grows.  Many chains may end at one URL, so the join splits hot ends.
    """
    chains = redirect_edges(index)
    covered = 1
    while covered <= max_hops:
        tails = chains.select(F.col("url").alias("end"), F.col("hops").alias("tail"), F.col("end").alias("tail_end"))
        grown = spread_join(
            chains, tails, ["end"], chains.groupBy("end").count(), "count", ["url"], rows_per_task
        )
        step = stage(
            grown.select(
                "url",
                F.when(F.col("tail").isNull(), F.col("hops")).otherwise(F.concat("hops", "tail")).alias("hops"),
                F.coalesce("tail_end", "end").alias("end"),
                F.col("tail").isNotNull().alias("grew"),
            ),
            f"chains-{covered}",
        )
        chains = step.drop("grew")
        covered *= 2
        if step.filter("grew").isEmpty():
            break
    return chains


def resolve_responses(
    index: DataFrame, max_hops: int = MAX_HOPS, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Every URL with its final response and the ``hops`` that led there (empty without redirects).

    Takes the columns of an index of responses, one row per URL, best staged; ``error`` is ``redirects``
    for chains that are too long and ``not fetched`` where the end of a chain has no response.
    """
    own = ["status", "content_type", "media_type", "error", "undecodable"]
    no_hops = F.array().cast("array<struct<status:int,url:string>>")
    chains = resolve_redirects(index, max_hops, rows_per_task)
    finals = index.select(F.col("url").alias("end"), *own, F.lit(True).alias("fetched"))
    redirected = spread_join(
        chains, finals, ["end"], chains.groupBy("end").count(), "count", ["url"], rows_per_task
    ).select(
        "url",
        F.col("end").alias("final_url"),
        "hops",
        *[F.col(c) for c in own if c != "error"],
        F.when(F.size("hops") > max_hops, F.lit("redirects"))
        .when(F.col("fetched").isNull(), F.lit("not fetched"))
        .otherwise(F.col("error"))
        .alias("error"),
    )
    direct = index.filter(F.col("next_url").isNull()).select(
        "url", F.col("url").alias("final_url"), no_hops.alias("hops"), *own
    )
    return direct.unionByName(redirected)
