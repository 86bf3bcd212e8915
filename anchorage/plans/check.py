"""The whole check: documents or records in, one tagged row per link out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markdown import heading_slug
from ..functions.named import on_columns
from ..functions.paths import normalize_path
from ..operators.extract import index_documents, index_responses, targets_of
from ..operators.fragments import resolve_fragments
from ..operators.outcomes import inventory, local_outcomes, look_up, remote_outcomes
from ..operators.skew import ROWS_PER_TASK, spread_join
from ..operators.staging import stage
from ..operators.targets import accepted, group_targets, parse_targets, rejected
from .report import details_of


def _no_suffix(df: DataFrame) -> DataFrame:
    # a join key that tells a missing fragment ('') from an empty one ('#')
    return df.withColumn("suffix", F.coalesce(F.concat(F.lit("#"), "fragment"), F.lit("")))


def stage_index(
    documents: DataFrame, root: str | None = None, slug: Callable[[Column], Column] = heading_slug
) -> DataFrame:
    """The local targets with their anchors, written once; texts are not read again."""
    return stage(index_documents(documents, slug, root).drop("links"), "documents")


def check_links(
    documents: DataFrame | None,
    responses: DataFrame | None = None,
    *,
    records: DataFrame | None = None,
    index: DataFrame | None = None,
    root: str | None = None,
    prefixes: Sequence[str] = (),
    follow: bool = False,
    urldecode: bool = False,
    empty_fragment_ok: bool = False,
    slug: Callable[[Column], Column] = heading_slug,
    rows_per_task: int = ROWS_PER_TASK,
) -> tuple[DataFrame, DataFrame]:
    """``(checked, rejects)``: every link with its ``tag`` and ``details``, and the unparsable links.

    ``documents`` are the sources of the links (unless ``records`` are given, such as those of an
    earlier report) and the local targets; ``responses`` are the remote targets.  An ``index`` that
    ``stage_index`` made of the documents spares parsing them again for further records.

    Texts and bodies are read once: what is staged of them are links and anchors.  Every distinct
    target is then looked up once, every distinct (target, fragment) resolved once, and only the
    last join touches all links.  Links of very popular targets are split over many tasks there.
    """
    if index is not None:
        targets = stage(parse_targets(records, root), "targets")
    elif records is None:
        index = index_documents(documents, slug, root)
        index = stage(index, "documents")
        targets = targets_of(index)
    else:
        index = stage_index(documents, root, slug)
        targets = stage(parse_targets(records, root), "targets")
    links = _no_suffix(accepted(targets))

    outcomes = local_outcomes(inventory(index))
    anchors = index.select(on_columns(normalize_path, "path").alias("target"), "anchors")
    if responses is not None:
        fetched = stage(index_responses(responses, slug), "responses")
        outcomes = outcomes.unionByName(
            remote_outcomes(fetched, follow=follow, rows_per_task=rows_per_task)
        )
        anchors = anchors.unionByName(fetched.select(F.col("url").alias("target"), "anchors"))
    anchors = anchors.select("target", F.explode_outer("anchors").alias("anchor")).filter(
        F.col("anchor").isNotNull()
    )

    wanted = stage(group_targets(links), "wanted")
    per_target = wanted.groupBy("kind", "target").agg(F.count(F.lit(1)).alias("n_fragments"))
    looked_up = look_up(per_target, outcomes, urldecode)
    fanned = spread_join(
        wanted, looked_up.drop("n_fragments"), ["kind", "target"], per_target, "n_fragments", ["fragment"], rows_per_task
    )
    if follow:
        fanned = stage(fanned, "looked-up")
    resolved = _no_suffix(
        resolve_fragments(
            fanned, anchors, prefixes, empty_fragment_ok, shared_documents=follow, rows_per_task=rows_per_task
        )
    )
    tagged = spread_join(
        links,
        resolved.drop("fragment", "n_links"),
        ["kind", "target", "suffix"],
        _no_suffix(wanted),
        "n_links",
        ["source", "doc_path", "doc_ord", "pos"],
        rows_per_task,
    )
    checked = tagged.withColumn("details", on_columns(details_of)).select(
        "doc_path", "doc_line", "link", "source", "doc_ord", "pos", "kind", "target", "fragment", "tag", "details"
    )
    return checked, rejected(targets)


def extract_only(records: DataFrame, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(unchecked, rejects)``: the links without looking anything up; ``tag`` is NULL."""
    targets = parse_targets(records, root)
    unchecked = accepted(targets).withColumns(
        {"tag": F.lit(None).cast("string"), "details": F.lit(None).cast("array<string>")}
    )
    return unchecked, rejected(targets)
