"""Arrays as sequences: running sums and maxima, in n log n and without a growing accumulator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _scan(rows: Column, value: Callable[[Column, Column], Column], combine: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running ``combine`` of ``value(row, i)``: in round k every entry takes in the one 2**k before it."""

    def take_in(now: Column, k: Column) -> Column:
        reach = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(now, lambda x, i: F.when(i >= reach, combine(x, F.get(now, i - reach))).otherwise(x))

    # Of the rows, as the values are an expression that would be computed again wherever it is used; no filter over
    # the rounds, which would ask for their number once a round.  A round that reaches too far changes nothing.
    rounds = F.ceil(F.log2(F.greatest(F.size(rows), F.lit(1)))).cast("int")
    return F.aggregate(F.sequence(F.lit(0), F.least(rounds, F.lit(30))), F.transform(rows, value), take_in)


def running_sum(rows: Column, value: Callable[[Column, Column], Column]) -> Column:
    return _scan(rows, value, lambda a, b: a + b)


def running_max(rows: Column, value: Callable[[Column, Column], Column]) -> Column:
    """Nulls count for nothing."""
    return _scan(rows, value, lambda a, b: F.greatest(a, b))
