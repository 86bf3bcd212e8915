"""Toxicity by a classifier chain over hashed words.

Categories are predicted in a given order.  The model of each category sees the text and the
probabilities of the categories before it.  In training these are out-of-fold: the rows of a fold get the
probabilities of a model that was fitted without them, so later models learn from probabilities as
uncertain as those that they will meet.

The chain is fitted in one task on at most ``max_rows`` labelled documents, a documented bound; all
documents are scored where they lie, without a shuffle.

Defined results: null and empty texts have only the base rate.  Labels that are null are not used.
Without labelled rows every probability is 0 and nothing is rejected.  Repeated rows are scored alike.
Extra columns are kept by ``without_toxic`` and ignored by ``score_toxicity``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import Words, slices, text_buffers
from .linear import Links, Sample, fit, text_sums, training_rows, word_features

MAX_ROWS = 8000
FOLDS = 3


def _fit_chain(categories: list[str], folds: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "text"], na_position="first")
        sample = Sample(pa.array(rows["text"], pa.string()))
        fold = np.arange(len(rows)) % folds
        extra, chain = np.zeros((0, len(rows))), []
        for name in categories:
            y = rows[name].to_numpy(np.int64).clip(0, 1)
            held_out = np.zeros(len(rows))
            for k in range(folds):
                model = fit(sample, y, extra, fold != k, 1)
                p = model.above(sample.sums(model.table()), extra)[0]
                held_out[fold == k] = p[fold == k]
            chain.append(fit(sample, y, extra, np.ones(len(rows), bool), 1))
            extra = np.concatenate([extra, held_out[None]])
        return pd.DataFrame({"model": [pickle.dumps(chain)]})

    return run


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    categories: dict[str, str],
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rows: int = MAX_ROWS,
    folds: int = FOLDS,
) -> list[Links]:
    """One model per category (a name, and its 0/1 label as SQL over ``labels``), in the order of the chain."""
    named = labels.select(id_col, *[F.expr(label).alias(name) for name, label in categories.items()])
    rows = training_rows(docs, named, id_col, text_col, list(categories), max_rows)
    got = rows.groupBy().applyInPandas(_fit_chain(list(categories), folds), "model binary").first()
    return pickle.loads(got["model"]) if got else [Links(np.full(1, 50.0), extra=np.zeros(i)) for i in range(len(categories))]


def score_toxicity(docs: DataFrame, chain: list[Links], names: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and one probability per category, in the order of the chain, one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [model.table() for model in chain]
        for batch in slices(batches, "text"):
            words = Words(*text_buffers(batch.column(1)))
            features = word_features(words)
            extra = np.zeros((0, batch.num_rows))
            for model, table in zip(chain, tables):
                extra = np.concatenate([extra, model.above(text_sums(table, words, features), extra)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p) for p in extra)], names=["id", *names])

    chosen = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    columns = ", ".join(f"`{name}` double" for name in names)
    return chosen.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, {columns}")


def without_toxic(docs: DataFrame, chain: list[Links], text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose last category has a probability of ``threshold`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [model.table() for model in chain]
        for batch in slices(batches, text_col):
            words = Words(*text_buffers(batch.column(batch.schema.get_field_index(text_col))))
            features = word_features(words)
            extra = np.zeros((0, batch.num_rows))
            for model, table in zip(chain, tables):
                extra = np.concatenate([extra, model.above(text_sums(table, words, features), extra)])
            yield batch.filter(pa.array(extra[-1] < threshold))

    return docs.mapInArrow(run, docs.schema)
