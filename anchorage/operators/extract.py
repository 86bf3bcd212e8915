"""Flat-maps over documents and responses: links, headings, anchors.  All narrow, one scan each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, markdown
from ..functions.named import on_columns
from ..functions.paths import normalize_path
from ..functions.urls import resolve_reference
from ..schemas import RECORDS, conform
from .targets import target_of


# The statuses that redirect.
REDIRECT_STATUSES = [301, 302, 303, 307, 308]


def _is_file() -> Column:
    return ~F.coalesce("is_dir", F.lit(False)) & F.col("io_error").isNull() & F.col("text").isNotNull()


def _lenient(text: Column) -> Column:
    # the target of a link is decoded leniently, with UTF-8 as the hint
    return F.when(F.is_valid_utf8(text) & ~text.startswith("\ufeff"), text).otherwise(
        html.decode_body(text.cast("binary"), F.lit("utf-8"))
    )


#: Columns that come and go while documents and responses are parsed.
_TEXT, _LINKS, _HEADINGS = "_text", "_links", "_headings"


def _body_text(media_type: Column, status: Column, content_type: Column, body: Column, error: Column) -> Column:
    wanted = media_type.isin("text/html", "text/markdown") & status.between(200, 299) & error.isNull()
    return F.when(wanted, html.decode_body(F.coalesce(body, F.lit(b"")), html.charset_hint(content_type)))


def _with_targets(links: Column, path: Column, root: str | None) -> Column:
    def add_target(link: Column, doc_key: Column) -> Column:
        return markdown.let(
            target_of(link["link"], doc_key, root),
            lambda to: F.struct(
                link["line"].alias("doc_line"), link["link"].alias("link"),
                *[to[c].alias(c) for c in ("kind", "target", "fragment", "reject")],
            ),
        )

    return markdown.let(normalize_path(path), lambda doc_key: F.transform(links, lambda link: add_target(link, doc_key)))


def _parsed(documents: DataFrame, *kept: Column | str, links: bool = True, headings: bool = True) -> DataFrame:
    """``kept`` columns with the links and headings of each file; links only where the text is UTF-8.

    A byte order mark is no part of the text.
    """
    texts = documents.select(
        *kept,
        F.when(_is_file(), on_columns(_lenient, "text")).alias(_TEXT),
        (_is_file() & F.is_valid_utf8("text")).alias("_source"),
    )
    parsed = markdown.with_links_and_headings(texts, _TEXT, _LINKS if links else None, _HEADINGS if headings else None)
    return parsed.drop(_TEXT)


def index_documents(
    documents: DataFrame,
    slug: Callable[[Column], Column] = markdown.heading_slug,
    root: str | None = None,
) -> DataFrame:
    """One row per document with its ``links`` (and their targets) and ``anchors``, and no text.

    This is what a check needs of a document, so a corpus is read once however often it is used.
    """
    parsed = _parsed(documents, "path", "doc_ord", F.coalesce("is_dir", F.lit(False)).alias("is_dir"), "io_error")
    return parsed.select(
        "path",
        "doc_ord",
        "is_dir",
        "io_error",
        F.when(F.col("_source"), on_columns(_with_targets, _LINKS, "path", root=root)).alias("links"),
        on_columns(markdown.anchors, _HEADINGS, slug=slug).alias("anchors"),
    )


def _exploded_links(rows: DataFrame) -> DataFrame:
    # the outer form keeps Catalyst from evaluating the links twice, once to filter out empty arrays
    return rows.select(
        F.col("path").alias("doc_path"), "doc_ord", F.posexplode_outer("links").alias("pos", "found")
    ).filter(F.col("pos").isNotNull())


def targets_of(index: DataFrame) -> DataFrame:
    """The links of an index with their targets: the rows that ``parse_targets`` gives for them."""
    rows = _exploded_links(index).select("doc_path", "doc_ord", "pos", "found.*")
    columns = [f.name for f in RECORDS.fields]
    return rows.withColumn("source", F.lit(None).cast("string")).select(
        *columns, "kind", "target", "fragment", "reject"
    )


def extract_links(documents: DataFrame) -> DataFrame:
    """Every link of every readable Markdown document with the line its text ends on."""
    sources = documents.filter(_is_file() & F.is_valid_utf8("text"))
    rows = _exploded_links(_parsed(sources, "path", "doc_ord", headings=False).withColumnRenamed(_LINKS, "links"))
    return conform(
        rows.select("doc_path", "doc_ord", "pos", F.col("found.line").alias("doc_line"), "found.link"),
        RECORDS,
    )


def extract_headings(documents: DataFrame) -> DataFrame:
    """``(path, pos, text, nth)``: heading texts in order, with the number of earlier equal ones."""
    found = _parsed(documents.filter(_is_file()), "path", links=False)
    rows = found.select("path", F.explode_outer(on_columns(markdown.number_repeats, _HEADINGS)).alias("h"))
    return rows.filter(F.col("h").isNotNull()).select("path", "h.pos", "h.text", "h.nth")


def _exploded(sets: DataFrame) -> DataFrame:
    return sets.select("target", F.explode_outer("anchors").alias("anchor")).filter(
        F.col("anchor").isNotNull()
    )


def document_anchor_sets(
    documents: DataFrame, slug: Callable[[Column], Column] = markdown.heading_slug
) -> DataFrame:
    """``(target, anchors)``: the anchor array of each local document, from its headings."""
    found = _parsed(documents.filter(_is_file()), on_columns(normalize_path, "path").alias("target"), links=False)
    return found.select("target", on_columns(markdown.anchors, _HEADINGS, slug=slug).alias("anchors"))


def document_anchors(
    documents: DataFrame, slug: Callable[[Column], Column] = markdown.heading_slug
) -> DataFrame:
    """``(target, anchor)`` for local documents, one row each."""
    return _exploded(document_anchor_sets(documents, slug))


def index_responses(
    responses: DataFrame, slug: Callable[[Column], Column] = markdown.heading_slug
) -> DataFrame:
    """One row per URL without the body: what a check needs of its response.

    Of several responses to one URL (fetched again, or spellings that normalize to the same) one counts,
    with its own anchors: one without error before one with, then success, then the lowest status; what is
    still equal goes by the other columns, so the choice does not depend on the order of the rows.

    ``next_url`` is where a redirect leads (NULL for others); ``media_type``, ``undecodable`` and
    ``anchors`` come from the header and the body.
    """
    redirects = (
        F.col("status").isin(REDIRECT_STATUSES) & F.col("location").isNotNull() & F.col("error").isNull()
    )
    next_url = F.when(redirects, on_columns(resolve_reference, "url", "location"))
    kept = ["url", "status", "content_type", "error", "next_url", "media_type"]
    typed = responses.withColumns({"next_url": next_url, "media_type": on_columns(html.media_type, "content_type")})
    read = on_columns(_body_text, "media_type", "status", "content_type", "body", "error")
    texts = typed.select(*kept, F.struct(read.alias("text")).alias("_body")).withColumn(_TEXT, F.col("_body.text"))
    wanted = F.col("media_type").isin("text/html", "text/markdown") & F.col("status").between(200, 299) & F.col("error").isNull()
    is_markdown = F.col("media_type") == "text/markdown"
    parsed = markdown.with_links_and_headings(texts.withColumn("_markdown", F.when(is_markdown, F.col(_TEXT))), "_markdown", headings=_HEADINGS)
    rows = parsed.select(
        *kept,
        (wanted & F.col(_TEXT).isNull()).alias("undecodable"),
        F.when(F.col("media_type") == "text/html", on_columns(html.html_anchors, _TEXT))
        .when(is_markdown, on_columns(markdown.anchors, _HEADINGS, slug=slug))
        .alias("anchors"),
    )
    others = [c for c in rows.columns if c != "url"]
    usable = F.col("error").isNull() & F.col("status").isNotNull()
    rank = F.when(usable & F.col("status").between(200, 299), 0).when(usable, 1).otherwise(2)
    return rows.groupBy("url").agg(F.min(F.struct(rank.alias("rank"), *others)).alias("best")).select(
        "url", *[F.col(f"best.{c}").alias(c) for c in others]
    )


def response_anchors(
    responses: DataFrame, slug: Callable[[Column], Column] = markdown.heading_slug
) -> DataFrame:
    """``(target, anchor)`` for fetched documents: HTML ids and names, Markdown headings, else none."""
    index = index_responses(responses, slug)
    return _exploded(index.select(F.col("url").alias("target"), "anchors"))


def list_anchors(sets: DataFrame) -> DataFrame:
    """The anchors of each target in sorted order; ``sets`` has one anchor array per target."""
    return sets.select("target", F.sort_array("anchors").alias("anchors"))
