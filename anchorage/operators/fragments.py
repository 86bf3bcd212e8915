"""Resolution of fragments to anchors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import ROWS_PER_TASK, spread_join


def _candidates(fragment: Column, tries: Sequence[str]) -> Column:
    """Anchors that may satisfy a fragment with their rank: exact, prefixed, then both in lower case.

    Lower case is only tried where it changes the fragment; it is the fragment that is lowered, not
    the anchors.
    """

    def ranked(text: Column, first: int) -> list[Column]:
        return [
            F.struct(F.lit(first + i).alias("rank"), F.concat(F.lit(prefix), text).alias("anchor"))
            for i, prefix in enumerate(tries)
        ]

    lower = F.lower(fragment)
    exact, lowered = ranked(fragment, 0), ranked(lower, len(tries))
    return F.when(lower == fragment, F.array(*exact)).otherwise(F.array(*exact, *lowered))


def resolve_fragments(
    wanted: DataFrame,
    anchors: DataFrame,
    prefixes: Sequence[str] = (),
    empty_fragment_ok: bool = False,
    shared_documents: bool = False,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Final ``tag`` and matched ``prefix`` of each distinct ``(kind, target, fragment)``.

    ``wanted`` has the outcome of the target in ``tag`` (NULL: found), its ``cause`` if known and ``anchor_key``; ``anchors``
    has ``(target, anchor)``.  A failed target keeps its tag and none of its fragments is looked at.

    Candidates meet anchors in one equi-join on both columns, so neither a target with very many
    anchors nor one with very many fragments ends up in one task.  Rows that need no anchor carry
    their own target and, behind a NUL, their fragment, which meets nothing and spreads them.

    With ``shared_documents`` (followed redirects) very many targets may mean one document, so that
    even one anchor can be hot; the join then splits such anchors.
    """
    if "cause" not in wanted.columns:
        wanted = wanted.withColumn("cause", F.lit(None).cast("string"))
    needs = F.col("tag").isNull() & F.col("fragment").isNotNull()
    if empty_fragment_ok:
        needs = needs & (F.col("fragment") != "")
    tries = ["", *dict.fromkeys(p for p in prefixes if p)]
    idle = F.array(
        F.struct(
            F.lit(None).cast("int").alias("rank"),
            F.concat(F.lit("\0"), F.coalesce("fragment", F.lit(""))).alias("anchor"),
        )
    )
    attempts = wanted.select(
        "kind", "target", "fragment", "n_links", F.col("tag").alias("doc_tag"), "hops", "cause",
        F.when(needs, F.col("anchor_key")).otherwise(F.col("target")).alias("anchor_key"),
        needs.alias("needs"),
        F.explode(F.when(needs, _candidates(F.col("fragment"), tries)).otherwise(idle)).alias("try"),
    ).withColumn("anchor", F.col("try.anchor"))
    present = anchors.select(F.col("target").alias("anchor_key"), "anchor", F.lit(True).alias("present"))
    keys = ["anchor_key", "anchor"]
    if shared_documents:
        counts = attempts.groupBy(*keys).count()
        joined = spread_join(attempts, present, keys, counts, "count", ["target", "fragment"], rows_per_task)
    else:
        joined = attempts.join(present, keys, "left")
    # All but the rank depend on the first three keys; as keys they allow a hash aggregate.
    best = (
        joined.groupBy("kind", "target", "fragment", "n_links", "doc_tag", "hops", "cause", "needs")
        .agg(F.min(F.when(F.col("present"), F.col("try.rank"))).alias("rank"))
    )
    rank = F.col("rank")
    tag = (
        F.when(F.col("doc_tag").isNotNull(), F.col("doc_tag"))
        .when(~F.col("needs") | (rank == 0), F.lit("OK"))
        .when(rank < len(tries), F.lit("PREFIXED"))
        .when(rank.isNotNull(), F.lit("CASE_FRAG"))
        .otherwise(F.lit("NO_FRAG"))
    )
    return best.select(
        "kind", "target", "fragment", "n_links", "hops", "cause",
        F.get(F.array(*[F.lit(p) for p in tries]), F.pmod(rank, F.lit(len(tries)))).alias("prefix"),
        tag.alias("tag"),
        F.col("doc_tag").isNotNull().alias("doc_failed"),
    )
