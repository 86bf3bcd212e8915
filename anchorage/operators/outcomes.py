"""What looking a target up gives: an error tag, or the document whose anchors count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.named import on_columns
from ..functions.paths import ancestors, normalize_path
from ..functions.text import let, percent_decode
from .redirects import resolve_responses

HOPS = "array<struct<status:int,url:string>>"


def _ancestors_of(path: Column) -> Column:
    return let(normalize_path(path), ancestors)


def _decoded_path(path: Column) -> Column:
    return let(percent_decode(path), normalize_path)


def inventory(documents: DataFrame) -> DataFrame:
    """``(target, is_dir, io_error)`` (two flags): all local paths that exist, once each.

    Every folder above a document exists; they are merged before the shuffle, so a folder with very
    many documents costs one row per map task.
    """
    path = on_columns(normalize_path, "path")
    own = documents.select(
        path.alias("target"),
        F.coalesce("is_dir", F.lit(False)).alias("is_dir"),
        F.col("io_error").isNotNull().alias("io_error"),
    )
    folders = documents.select(
        F.explode(on_columns(_ancestors_of, "path")).alias("target")
    ).select(
        "target", F.lit(True).alias("is_dir"), F.lit(False).alias("io_error")
    )
    return (
        own.unionByName(folders)
        .groupBy("target")
        .agg(F.max("is_dir").alias("is_dir"), F.max("io_error").alias("io_error"))
    )


def local_outcomes(existing: DataFrame) -> DataFrame:
    """Outcome of every existing local path: DIR, IO_ERR, or NULL and its own anchors."""
    return existing.select(
        F.lit("path").alias("kind"),
        "target",
        F.when(F.col("is_dir"), F.lit("DIR")).when(F.col("io_error"), F.lit("IO_ERR")).alias("tag"),
        F.col("target").alias("anchor_key"),
        F.array().cast(HOPS).alias("hops"),
        F.when(~F.col("is_dir") & F.col("io_error"), F.lit("could not be read")).alias("cause"),
    )


def remote_outcomes(index: DataFrame, follow: bool = False, **redirects: int) -> DataFrame:
    """Outcome of every fetched URL, in the order in which a fetch can fail.

    Without ``follow`` a redirect is reported by the status of its first hop, but only if the chain
    ends well: the failure of the final response comes first.
    """
    error, status, kind = F.col("error"), F.col("status"), F.col("media_type")
    parsed = kind.isin("text/html", "text/markdown")
    text_header = ~F.col("content_type").rlike(r"[^\x20-\x7e\t]")
    tag = (
        F.when(error == "timeout", F.lit("TIMEOUT"))
        .when(error.isNotNull() & (error != "body_read"), F.lit("HTTP_OTH"))
        .when(status.isNull(), F.lit("HTTP_OTH"))
        .when(~status.between(200, 299), F.concat(F.lit("HTTP_"), status.cast("string")))
    )
    if not follow:
        tag = tag.when(
            F.size("hops") > 0, F.concat(F.lit("HTTP_"), F.get("hops", F.lit(0))["status"].cast("string"))
        )
    tag = (
        tag.when(F.col("content_type").isNull(), F.lit("NO_MIME"))
        .when(~text_header, F.lit("HTTP_OTH"))
        .when(kind.isNull(), F.lit("MIME"))
        .when(parsed & (error == "body_read"), F.lit("IO_ERR"))
        .when(F.col("undecodable"), F.lit("DEC_ERR"))
    )
    # hops are what the tag tells of only where the chain ends well; the failure of its end is another matter
    ends_well = (error.isNull() | (error == "body_read")) & status.between(200, 299)
    none = F.array().cast(HOPS)
    hops = none if follow else F.when(ends_well, F.col("hops")).otherwise(none)
    # why the tag is what it is, where the tag does not say it
    cause = (
        F.when(error == "timeout", F.lit(None))
        .when(error == "redirects", F.lit("too many redirects"))
        .when(error == "not fetched", F.concat(F.lit("not fetched: "), F.col("final_url")))
        .when(error.isNotNull() & (error != "body_read"), error)
        .when(status.isNull(), F.lit("no status"))
        .when(tag == "HTTP_OTH", F.lit("content type is not text"))
        .when(tag == "IO_ERR", F.lit("body could not be read"))
    )
    resolved = resolve_responses(index, **redirects)
    return resolved.select(
        F.lit("url").alias("kind"),
        F.col("url").alias("target"),
        tag.alias("tag"),
        F.col("final_url").alias("anchor_key"),
        hops.alias("hops"),
        cause.cast("string").alias("cause"),
    )


def look_up(targets: DataFrame, outcomes: DataFrame, urldecode: bool = False) -> DataFrame:
    """Outcome of each distinct ``(kind, target)``: one equi-join for local and remote targets.

    Adds ``tag`` (NULL: the document is there), ``anchor_key``, ``hops`` and ``cause`` (of some tags).  With ``urldecode`` a
    local path that cannot be opened is tried again percent-decoded.
    """
    missing = (
        F.when(F.col("kind") == "absolute", F.lit("ABSOLUTE"))
        .when((F.col("kind") == "url") & ~F.col("target").rlike("^https?:"), F.lit("PROTOCOL"))
        .when(F.col("found").isNotNull(), F.col("found_tag"))
        .when(F.col("kind") == "url", F.lit("HTTP_OTH"))
        .otherwise(F.lit("NO_DOC"))
    )
    found = outcomes.select(
        "kind",
        F.col("target").alias("key"),
        F.lit(True).alias("found"),
        F.col("tag").alias("found_tag"),
        "anchor_key",
        "hops",
        "cause",
    )
    # a URL that was never fetched has no row that could say so
    cause = F.when((missing == "HTTP_OTH") & F.col("found").isNull(), F.lit("not fetched")).otherwise(F.col("cause"))
    if not urldecode:
        joined = targets.withColumn("key", F.col("target")).join(found, ["kind", "key"], "left")
        return joined.withColumns({"tag": missing, "cause": cause}).drop("key", "found", "found_tag")

    decoded = F.when(F.col("kind") == "path", on_columns(_decoded_path, "target"))
    tries = targets.withColumn(
        "try",
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(F.lit(0).alias("rank"), F.col("target").alias("key")),
                    F.when(decoded != F.col("target"), F.struct(F.lit(1).alias("rank"), decoded.alias("key"))),
                )
            )
        ),
    ).select("*", "try.rank", "try.key").drop("try")
    joined = tries.join(found, ["kind", "key"], "left")
    result = F.struct("found", "found_tag", "anchor_key", "hops", "cause")
    others = [c for c in targets.columns if c not in ("kind", "target")]
    best = joined.groupBy("kind", "target").agg(
        *[F.first(c).alias(c) for c in others],
        F.max(F.when(F.col("rank") == 0, result)).alias("plain"),
        F.max(F.when(F.col("rank") == 1, result)).alias("retry"),
    )
    plain_opens = F.col("plain.found").isNotNull() & (F.col("plain.found_tag").isNull() | (F.col("plain.found_tag") == "DIR"))
    retried = F.col("retry").isNotNull() & ~plain_opens
    # a folder that only the retry finds is opened like a file, which fails when it is read
    retry_tag = F.when(F.col("retry.found_tag") == "DIR", F.lit("IO_ERR")).otherwise(F.col("retry.found_tag"))
    pick = lambda c: F.when(retried, F.col(f"retry.{c}")).otherwise(F.col(f"plain.{c}"))
    return (
        best.withColumns(
            {
                "found": pick("found"),
                "found_tag": F.when(retried, retry_tag).otherwise(F.col("plain.found_tag")),
                "anchor_key": pick("anchor_key"),
                "hops": pick("hops"),
                "cause": pick("cause"),
            }
        )
        .withColumns({"tag": missing, "cause": cause})
        .drop("plain", "retry", "found", "found_tag")
    )
