"""Names for helper columns that no column of the caller has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def free_name(frame: DataFrame, wanted: str, *others: DataFrame) -> str:
    """``wanted``, with underscores before it until no column of the frames has that name in any case."""
    taken = {c.lower() for f in (frame, *others) for c in f.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def without_ids(docs: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id is in the one column of ``ids``."""
    key = free_name(docs, "id")
    gone = ids.toDF(key)
    return docs.join(gone, docs[id_col] == gone[key], "left_anti")
