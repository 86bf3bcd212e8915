"""Quality by ordinal cumulative-link regression on graded ratings.

One set of hashed-text weights serves all grades; ordered thresholds cut the score into grades, so
P(grade > k) falls with k.  The results are the expected grade and every tail probability, for selection.

Fitted in one task on at most ``max_rows`` rated documents, a documented bound; all documents are scored
where they lie, without a shuffle.

Defined results: null and empty texts have only the base rates.  Ratings that are null are not used.
Without rated rows every tail probability is 0 and the expected grade 0.  Repeated rows are scored alike.
Extra columns are ignored.
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


def _fit_grades(top: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "text"], na_position="first")
        y = rows["grade"].to_numpy(np.int64).clip(0, top)
        model = fit(Sample(pa.array(rows["text"], pa.string())), y, np.zeros((0, len(rows))), np.ones(len(rows), bool), top)
        return pd.DataFrame({"model": [pickle.dumps(model)]})

    return run


def fit_quality(
    docs: DataFrame, ratings: DataFrame, grade: str, top: int, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS
) -> Links:
    """The model of grades 0 to ``top``; ``grade`` is SQL over ``ratings``."""
    rows = training_rows(docs, ratings.select(id_col, F.expr(grade).alias("grade")), id_col, text_col, ["grade"], max_rows)
    got = rows.groupBy().applyInPandas(_fit_grades(top), "model binary").first()
    return pickle.loads(got["model"]) if got else Links(np.full(top, 50.0))


def score_quality(docs: DataFrame, model: Links, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, expected_grade, p_tail`` per row of ``docs``; ``p_tail[k]`` is P(grade > k)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, none = model.table(), np.zeros((0, 0))
        for batch in slices(batches, "text"):
            words = Words(*text_buffers(batch.column(1)))
            tails = model.above(text_sums(table, words, word_features(words)), none)
            column = pa.FixedSizeListArray.from_arrays(pa.array(tails.T.ravel()), len(tails)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(axis=0)), column], names=["id", "expected_grade", "p_tail"])

    chosen = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return chosen.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, expected_grade double, p_tail array<double>")
