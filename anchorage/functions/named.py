"""Build the larger column expressions once per process instead of once per query."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=256)
def on_columns(fn: Callable[..., Column], *names: str, **options: Any) -> Column:
    """``fn`` applied to the columns with these names.

    A column is only a description, and the same one serves any number of frames; building one from
    Python takes a call into the JVM per node, which adds up to seconds for the long expressions.
    """
    return fn(*[F.col(name) for name in names], **options)

