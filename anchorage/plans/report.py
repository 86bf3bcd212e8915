"""Report rows: order, muting, formatting, details."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import describe, parse_tag, tags

ORDER = ["source", "doc_ord", "doc_path", "pos"]


def mute(checked: DataFrame, names: Iterable[str]) -> DataFrame:
    """Hide the links with one of the named tags; links that were not checked always stay."""
    muted = sorted({parse_tag(name) for name in names})
    if not muted:
        return checked
    return checked.filter(F.col("tag").isNull() | ~F.col("tag").isin(muted))


def in_input_order(checked: DataFrame) -> DataFrame:
    """Rows in the order of the input: a range sort, only needed for output."""
    return checked.orderBy(*[F.col(c).asc_nulls_first() for c in ORDER])


def report_line() -> Column:
    return F.format_string("%s:%d: %s %s", "doc_path", "doc_line", F.coalesce("tag", F.lit("")), "link")


def format_report(checked: DataFrame, link_only: bool = False) -> DataFrame:
    """One ``line`` per link; a link that was not checked has an empty tag, hence two spaces."""
    line = F.col("link") if link_only else report_line()
    keys = [c for c in ORDER if c in checked.columns]
    return checked.select(*keys, line.alias("line"))


def write_report(checked: DataFrame, location: str, link_only: bool = False, compression: str = "none") -> None:
    """Write the report as text files whose order is the order of the input."""
    lines = in_input_order(format_report(checked, link_only)).select("line")
    lines.write.option("compression", compression).text(location)


def details_of() -> Column:
    """Why a link got its tag: a title, then the context, the most general first.

    Works on ``tag``, ``target``, ``fragment``, ``prefix``, ``hops`` (only where a redirect is what the
    tag reports), ``cause`` (why the document failed) and ``doc_failed``.
    """
    tag, fragment = F.col("tag"), F.col("fragment")
    context = lambda *parts: F.concat(F.lit("  context: "), *parts)
    in_fragment = ~F.col("doc_failed")
    is_redirect = F.col("doc_failed") & (F.size("hops") > 0)
    hops = F.when(
        is_redirect,
        F.transform(
            "hops",
            lambda h: context(F.lit("redirect("), h["status"].cast("string"), F.lit(") = "), h["url"]),
        ),
    ).otherwise(F.array().cast("array<string>"))
    lines = F.array_compact(
        F.array(
            describe(tag),
            context(F.lit("link = "), F.col("target")),
            F.when(in_fragment, context(F.lit("fragment = #"), fragment)),
            F.when(in_fragment & (tag == "CASE_FRAG"), context(F.lit("anchor = #"), F.lower(fragment))),
            F.when(in_fragment & (tag == "PREFIXED"), context(F.lit("prefix = "), F.col("prefix"))),
        )
    )
    # Fixed value: the cause that is named where no charset was found.
    undecoded = F.when(tag == "DEC_ERR", F.lit("Failed to detect character encoding"))
    cause = F.coalesce(undecoded, F.when(F.col("doc_failed"), F.col("cause")))
    caused = F.array_compact(F.array(F.concat(F.lit("  caused by: "), cause)))
    return F.when(tag != "OK", F.concat(lines, hops, caused))


def explain_details(checked: DataFrame) -> DataFrame:
    """The detail lines of every link that is not OK, one row each (``n`` counts from 0)."""
    keys = [c for c in [*ORDER, "doc_line", "link", "tag"] if c in checked.columns]
    return checked.select(*keys, F.posexplode_outer("details").alias("n", "detail")).filter(
        F.col("n").isNotNull()
    )


def tag_lookup(checked: DataFrame) -> DataFrame:
    """Add the ``description`` and ``http_status`` of the tag.

    The tag dimension has a fixed size (under 100 rows), so it is broadcast whatever the input.
    """
    spark = checked.sparkSession
    joined = checked.join(F.broadcast(tags(spark)), "tag", "left")
    status = F.when(F.col("tag").rlike("^HTTP_[0-9]+$"), F.substring("tag", 6, 3).cast("int"))
    return joined.withColumns(
        {
            "description": F.coalesce("description", describe(F.col("tag"))),
            "http_status": F.coalesce("http_status", status),
        }
    )


def tag_counts(checked: DataFrame) -> DataFrame:
    return checked.groupBy("tag").agg(F.count(F.lit(1)).alias("n_links"))
