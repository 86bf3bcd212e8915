"""The corpus pipeline: documents in, tokens of the documents worth training on out.

Each stage takes ``(spark, docs, sf_dir)``, works on all that the stage before kept, and is written as
Parquet before the next one reads it.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from anchorage.llm.bpe import tokenize
from anchorage.llm.decontamination import decontaminate
from anchorage.llm.exact import keep_distinct
from anchorage.llm.jaccard import keep_one_of_each
from anchorage.llm.queries import CATEGORIES, RANKS_PATH, TOXIC_FROM
from anchorage.llm.toxicity import fit_toxicity, without_toxic
from anchorage.operators.staging import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the chain calls toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return without_toxic(docs, fit_toxicity(docs, labels, CATEGORIES), threshold=TOXIC_FROM)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of equal texts the one with the largest id stays."""
    return keep_distinct(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of documents connected by 5-word Jaccard similarities of 0.8 or more, the smallest id stays."""
    return keep_one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that hold a benchmark item go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: every document with its token ids."""
    return tokenize(docs, RANKS_PATH, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("byte-level BPE", encode),
]

#: SQL can express neither a fitted classifier nor byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
