"""Small Column helpers shared by the expression libraries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once a row however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), 0)


def literals(values: Sequence) -> Column:
    """A constant array. Long ones are one literal that is split when the plan is made: plans stay small."""
    if len(values) > 8 and all(isinstance(v, (str, int)) and "|" not in str(v) for v in values):
        out = F.split(F.lit("|".join(map(str, values))), r"\|")
        return out if isinstance(values[0], str) else out.cast("array<int>")
    return F.array(*map(F.lit, values))


def pick(values: Sequence[str], index: Column) -> Column:
    """The value at ``index`` modulo the number of values."""
    return F.get(literals(values), F.pmod(index, F.lit(len(values))).cast("int"))


def blank(value: Column) -> Column:
    return value.isNull() | (F.trim(value) == "")


def bucketed(value: Column, cuts: Sequence[float]) -> Column:
    """How many of the ascending ``cuts`` lie below ``value``."""
    return F.size(F.filter(literals([float(c) for c in cuts]), lambda c: c < value)) if cuts else F.lit(0)
