"""The registered queries of this subpackage: (spark, sf_dir) -> DataFrame, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from .bpe import round_trip
from .conversations import damaged, digests, plan_edits, repaired_rows
from .decontamination import contaminated
from .exact import exact_duplicates
from .jaccard import similar_sets
from .lines import drop_repeated_lines
from .pii import KINDS, find_personal_data, listed
from .quality import fit_quality, score_quality
from .search import rank_documents
from .sharding import assign_shards
from .substrings import drop_repeated_substrings
from .suffixes import drop_repeated_bytes
from .toxicity import fit_toxicity, score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RANKS_PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


#: The chain: what the ratings call poor, then what they call toxic.
CATEGORIES = {"p_low_quality": "1 - quality", "p_toxic": "toxic"}
TOXIC_FROM = 0.5
#: Graded ratings: 0 poor, 1 fair but toxic, 2 good.
GRADE = "CASE WHEN quality = 0 THEN 0 WHEN quality = 1 AND toxic = 1 THEN 1 WHEN quality = 1 AND toxic = 0 THEN 2 END"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    chain = fit_toxicity(docs, _table(spark, sf_dir, "labels"), CATEGORIES)
    return score_toxicity(docs, chain, list(CATEGORIES)).select(
        F.col("id").alias("doc_id"), *CATEGORIES, (F.col("p_toxic") >= TOXIC_FROM).alias("toxic")
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_quality(docs, _table(spark, sf_dir, "labels"), GRADE, 2)
    return score_quality(docs, model).select(
        F.col("id").alias("doc_id"),
        "expected_grade",
        F.col("p_tail")[0].alias("p_fair"),
        F.col("p_tail")[1].alias("p_good"),
        (F.col("p_tail")[0] >= 0.5).alias("keep"),
    )


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"), RANKS_PATH, public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_substrings(_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(_table(spark, sf_dir, "documents"))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, k)) for k in range(len(KINDS) - 1)]
    counts = [(F.size("spans") - rest).cast("bigint").alias(f"n_{name}") for rest, name in zip(counts, KINDS)]
    every = F.array_sort(F.concat("spans", "added"))
    return found.select(
        F.col("id").alias("doc_id"), *counts, F.sha2(listed(F.col("spans")), 256).alias("base_sha256"), listed(every).alias("spans")
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_bytes(_table(spark, sf_dir, "documents"), 400).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("runs").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(_table(spark, sf_dir, "documents"), n=3, threshold=(90, 100)).select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id")
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    rows = damaged(conversations)
    edits = plan_edits(rows, dropped="dropped")
    texts = digests(repaired_rows(rows, edits, dropped="dropped")).withColumnRenamed("conv", "of")
    id_type = conversations.schema["conv_id"].dataType
    return edits.join(texts, edits["conv"].eqNullSafe(texts["of"]), "left").select(
        F.col("conv").cast(id_type).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20)
    return ranked.withColumnRenamed("query_id", "item_id")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(_table(spark, sf_dir, "documents"), shards=40)
    return placed.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality": op4_quality,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_pii": op7_pii,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_lexical_search": op12_lexical_search,
    "op13_sharding": op13_sharding,
}
