"""Mergeable states of the five functions, as Columns: two doubles s0, s1.

sum: (total, null)   count: (rows, null)   min, max: (value, null)   avg: (total, values counted)
A state without contribution has null s0. Sums skip null values; count counts rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..definitions import Function

ONE = "double"


def plain(aggregate: Column) -> Column:
    return aggregate


def lift(function: Function, column: str | None, where: Column | None = None, over: Callable[[Column], Column] = plain) -> tuple[Column, Column]:
    """Aggregates that make a state of rows; with `where`, of the rows for which it holds; `over` puts
    an aggregate over a window."""
    held = lambda c: c if where is None else F.when(where, c)
    if function is Function.COUNT:
        n = over(F.count(held(F.lit(1))))
        return F.when(n > 0, n).cast(ONE), F.lit(None).cast(ONE)
    value = held(F.col(column).cast(ONE))
    if function is Function.AVG:
        n = over(F.count(value))
        return over(F.sum(value)), F.when(n > 0, n).cast(ONE)
    one = {Function.SUM: F.sum, Function.MIN: F.min, Function.MAX: F.max}[function]
    return over(one(value)), F.lit(None).cast(ONE)


def combine(function: Function, s0: Column, s1: Column, over: Callable[[Column], Column] = plain) -> tuple[Column, Column]:
    """Aggregates that merge states."""
    one = {Function.MIN: F.min, Function.MAX: F.max}.get(function, F.sum)
    return over(one(s0)), over(F.sum(s1)) if function is Function.AVG else F.lit(None).cast(ONE)


def merge(function: Function, states: Iterable[tuple[Column, Column]]) -> tuple[Column, Column]:
    """Merges a row's states; a null state adds nothing."""
    zeros, ones = zip(*states)
    if function is Function.MIN:
        return F.least(*zeros), ones[0]
    if function is Function.MAX:
        return F.greatest(*zeros), ones[0]

    def total(parts):
        some = F.coalesce(*parts)
        return F.when(some.isNotNull(), sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)))

    return total(zeros), total(ones)


def finalize(function: Function, s0: Column, s1: Column) -> Column:
    """The feature's value: an empty sum or count is 0.0, an empty min, max or avg is null."""
    if function in (Function.SUM, Function.COUNT):
        return F.coalesce(s0, F.lit(0.0))
    if function is Function.AVG:
        return F.when(s1 > 0, s0 / s1)
    return s0

