"""Fetched responses: one row per URL from a crawl archive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.named import on_columns
from ..functions.urls import normalize_url, parse_url
from ..schemas import REJECTS, RESPONSES, conform


def responses_from_table(df: DataFrame, url: str = "url") -> DataFrame:
    """Responses out of a table that has at least a url column; URLs are normalized.

    ``error`` is NULL, ``timeout``, ``body_read`` or any other text for a transport error.  Rows whose
    URL cannot be parsed are left to ``rejected_responses``.
    """
    return conform(df.withColumn("url", on_columns(normalize_url, url)), RESPONSES).filter(
        F.col("url").isNotNull()
    )


def rejected_responses(df: DataFrame, url: str = "url") -> DataFrame:
    """The rows that ``responses_from_table`` leaves out (rejects schema)."""
    reason = on_columns(parse_url, url)["reject"]
    return conform(
        df.select(F.col(url).alias("source"), F.col(url).alias("value"), F.coalesce(reason, F.lit("NOT_ABSOLUTE")).alias("reason")).filter(
            on_columns(normalize_url, url).isNull()
        ),
        REJECTS,
    )
