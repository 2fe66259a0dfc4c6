"""Check digits as Column expressions: Luhn, Verhoeff and the base-36 code of tax numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakspark.functions.expr import let, literals

BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _dihedral(a: int, b: int) -> int:
    """Composition in the group of the pentagon's ten symmetries, rotations first."""
    turn = (a + b if a < 5 else a - b) % 5
    return turn + 5 * ((a < 5) != (b < 5))


_STEP = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)  # fixed value: Verhoeff's permutation
PRODUCT = [_dihedral(a, b) for a in range(10) for b in range(10)]
_rows = [list(range(10))]
while len(_rows) < 8:
    _rows.append([_STEP[x] for x in _rows[-1]])
POWERS = [x for r in _rows for x in r]
INVERSE = [next(b for b in range(10) if _dihedral(a, b) == 0) for a in range(10)]


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _digit(s: Column, i: Column) -> Column:
    """The i-th digit of ``s`` from its end, from 0."""
    return F.substring(s, F.length(s) - i, F.lit(1)).cast("int")


def _places(s: Column) -> Column:
    return F.when(F.length(s) > 0, F.sequence(F.lit(0), F.length(s) - 1)).otherwise(F.array().cast("array<int>"))


def luhn_sum(s: Column, shift: int = 0) -> Column:
    """Luhn sum of a digit string; ``shift`` 1 doubles the last digit as well, for a check digit yet to come."""
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(_places(s), F.lit(0), lambda acc, i: acc + F.when((i + shift) % 2 == 1, twice(_digit(s, i))).otherwise(_digit(s, i)))


def luhn_valid(value: Column) -> Column:
    return let(only_digits(value), lambda s: (F.length(s) > 0) & (luhn_sum(s) % 10 == 0))


def luhn_digit(s: Column) -> Column:
    return F.pmod(F.lit(10) - luhn_sum(s, 1) % 10, F.lit(10)).cast("string")


def _verhoeff(s: Column, shift: int) -> Column:
    d, p = literals(PRODUCT), literals(POWERS)
    return F.aggregate(_places(s), F.lit(0), lambda c, i: F.get(d, c * 10 + F.get(p, (i + shift) % 8 * 10 + _digit(s, i))))


def verhoeff_valid(value: Column) -> Column:
    return let(only_digits(value), lambda s: (F.length(s) > 0) & (_verhoeff(s, 0) == 0))


def verhoeff_digit(s: Column) -> Column:
    return F.get(literals(INVERSE), _verhoeff(s, 1)).cast("string")


def gstin_digit(body: Column) -> Column:
    """The 15th character of a tax number from its first 14: products by 1 and 2 in turn, as base-36 digit sums."""
    value = lambda i: F.instr(F.lit(BASE36), F.substring(body, i + 1, F.lit(1))) - 1
    total = F.aggregate(F.sequence(F.lit(0), F.lit(13)), F.lit(0), lambda acc, i: let(value(i) * (i % 2 + 1), lambda x: acc + (x / 36).cast("int") + x % 36))
    return F.substring(F.lit(BASE36), F.pmod(F.lit(36) - total % 36, F.lit(36)) + 1, F.lit(1))


def gstin_valid(value: Column) -> Column:
    return (F.length(value) == 15) & (gstin_digit(F.upper(F.substring(value, 1, 14))) == F.upper(F.substring(value, 15, 1)))


def has_check(pattern: str):
    """The test that a pattern's matches must pass, or None."""
    return {"CREDIT_CARD": luhn_valid, "AADHAAR": verhoeff_valid, "GSTIN": gstin_valid}.get(pattern)
