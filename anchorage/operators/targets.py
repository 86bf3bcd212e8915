"""Projection of a link to what it points at: ``(kind, target, fragment)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.named import on_columns
from ..functions.paths import normalize_path, parent_folder
from ..functions.text import let
from ..functions.urls import parse_url
from ..schemas import REJECTS, conform


def _local(link: Column, doc_key: Column, root: str | None) -> Column:
    split = F.split(link, "#", 2)

    def resolve(parts: Column) -> Column:
        path = parts["path"]
        inside = F.regexp_replace(path, "^/+", "")
        if root is None:
            absolute = inside
            kind = F.when(path.startswith("/"), F.lit("absolute")).otherwise(F.lit("path"))
        else:
            absolute = F.concat(F.lit(root.rstrip("/") + "/"), inside)
            kind = F.lit("path")
        full = (
            F.when(path.startswith("/"), absolute)
            .when(path == "", doc_key)
            .otherwise(F.concat(parent_folder(doc_key), path))
        )
        return F.struct(
            kind.alias("kind"),
            normalize_path(full).alias("target"),
            parts["fragment"].alias("fragment"),
            F.lit(None).cast("string").alias("reject"),
        )

    return let(
        F.struct(
            F.get(split, F.lit(0)).alias("path"), F.get(split, F.lit(1)).alias("fragment")
        ),
        resolve,
    )


def target_of(link: Column, doc_key: Column, root: str | None = None) -> Column:
    """``struct<kind, target, fragment, reject>`` of a link in the document with the path ``doc_key``."""

    def project(url: Column) -> Column:
        remote = F.struct(
            F.lit("url").alias("kind"),
            F.when(url["reject"].isNull(), url["key"]).alias("target"),
            url["fragment"].alias("fragment"),
            url["reject"].alias("reject"),
        )
        return F.when(url.isNotNull(), remote).otherwise(_local(link, doc_key, root))

    return let(parse_url(link), project)


def _target_in(link: Column, doc_path: Column, root: str | None) -> Column:
    return let(normalize_path(doc_path), lambda doc_key: target_of(link, doc_key, root))


def parse_targets(records: DataFrame, root: str | None = None) -> DataFrame:
    """Add ``kind``, ``target``, ``fragment`` and ``reject`` to link records.

    * ``url``: an absolute URL, normalized; ``path``: a local path, resolved from the document's
      own normalized path; ``absolute``: a root-absolute path with no ``root`` to join it to.
    * ``fragment`` is NULL where the link has no ``#`` and '' where nothing follows it.
    * ``reject`` is the reason why a URL cannot be parsed, else NULL.
    """

    to = on_columns(_target_in, "link", "doc_path", root=root)
    # as a generator the projection is evaluated once, although a filter on its result follows
    return records.select(*records.columns, F.inline_outer(F.array(to)))


def accepted(targets: DataFrame) -> DataFrame:
    return targets.filter(F.col("reject").isNull()).drop("reject")


def rejected(targets: DataFrame) -> DataFrame:
    """Links that cannot be parsed (rejects schema): ``path:line`` as the source, the link, the reason."""
    return conform(
        targets.filter(F.col("reject").isNotNull()).select(
            F.format_string("%s:%d", "doc_path", "doc_line").alias("source"),
            F.col("link").alias("value"),
            F.col("reject").alias("reason"),
        ),
        REJECTS,
    )


def group_targets(targets: DataFrame) -> DataFrame:
    """Distinct ``(kind, target, fragment)`` with the number of links, summed up before the shuffle."""
    return targets.groupBy("kind", "target", "fragment").agg(F.count(F.lit(1)).alias("n_links"))


def distinct_targets(targets: DataFrame) -> DataFrame:
    """Every target once, with its numbers of distinct fragments and of links."""
    return (
        group_targets(targets)
        .groupBy("kind", "target")
        .agg(F.count(F.lit(1)).alias("n_fragments"), F.sum("n_links").alias("n_links"))
    )


def rewrite_links(
    records: DataFrame, pattern: str, replacement: str, everywhere: bool = False
) -> DataFrame:
    """Replace the first match of a regular expression in every link (or all, if ``everywhere``).

    Only links change, never the paths of the documents; ``$1`` in the replacement is a group.
    """
    link = F.col("link")
    if everywhere:
        return records.withColumn("link", F.regexp_replace(link, pattern, replacement))
    at = F.regexp_instr(link, F.lit(pattern))
    rest = F.substring(link, at, F.length(link))
    first = F.concat(
        F.substring(link, F.lit(1), at - 1), F.regexp_replace(rest, f"^(?:{pattern})", replacement)
    )
    return records.withColumn("link", F.when(at > 0, first).otherwise(link))
