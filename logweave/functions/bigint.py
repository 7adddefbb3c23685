"""Exact sums of integers held as decimal text, beyond Spark's 38 digits.

A value is split into three 26-digit limbs. Each limb is summed as decimal(38,0), so the
sums are ordinary partial + final aggregates and stay exact up to 10^12 rows a group.
Carries are settled once per group, after the aggregation.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_LIMB = 26
_BASE = 10**_LIMB


def _num(value: int) -> Column:
    return F.lit(Decimal(value)).cast("decimal(28,0)")


def _limb(digits: Column, i: int) -> Column:
    text = F.substring(F.lpad(digits, 3 * _LIMB, "0"), 3 * _LIMB - _LIMB * (i + 1) + 1, _LIMB)
    limb = F.when(F.length(digits) <= _LIMB * i, _num(0)).otherwise(text.cast("decimal(28,0)"))
    if i:
        return limb
    return F.when(
        F.length(digits) <= 18, digits.cast("bigint").cast("decimal(28,0)")
    ).otherwise(limb)


def limbs(value: Column, signed: bool = False) -> list[Column]:
    """Three decimal(28,0) columns, lowest first, each carrying the sign of the value."""
    digits = F.ltrim(value, F.lit("-")) if signed else value
    parts = [_limb(digits, i) for i in range(3)]
    if not signed:
        return parts
    return [F.when(value.startswith("-"), -p).otherwise(p).cast("decimal(28,0)") for p in parts]


def _digits(sums: list[Column]) -> tuple[Column, Column]:
    """(top limb, text of the lower two limbs) after settling carries."""
    low = F.pmod(sums[0], _num(_BASE))
    carry = F.call_function("div", sums[0] - low, _num(_BASE))
    middle_sum = sums[1] + carry.cast("decimal(28,0)")
    middle = F.pmod(middle_sum, _num(_BASE))
    top = sums[2] + F.call_function("div", middle_sum - middle, _num(_BASE)).cast("decimal(28,0)")
    tail = F.concat(*[F.lpad(x.cast("string"), _LIMB, "0") for x in (middle, low)])
    return top, tail


def _strip(text: Column) -> Column:
    stripped = F.ltrim(text, F.lit("0"))
    return F.when(stripped == "", "0").otherwise(stripped)


def combine(sums: list[Column]) -> Column:
    """Decimal text of limb sums of any sign."""
    top, tail = _digits(sums)
    negated_top, negated_tail = _digits([-s for s in sums])
    return F.when(top < 0, F.concat(F.lit("-"), _strip(F.concat(negated_top.cast("string"), negated_tail)))).otherwise(
        _strip(F.concat(top.cast("string"), tail))
    )


def sum_u256(value: Column) -> Column:
    """Aggregate: exact sum of unsigned decimal text, as decimal text."""
    return combine([F.sum(p) for p in limbs(value)])


def sum_signed(value: Column) -> Column:
    """Aggregate: exact sum of signed decimal text, as signed decimal text."""
    return combine([F.sum(p) for p in limbs(value, signed=True)])


def sum_weighted(value: Column, sign: Column) -> Column:
    """Aggregate: exact sum of sign * value, sign being +1 or -1, value unsigned."""
    return combine([F.sum((p * sign.cast("decimal(1,0)")).cast("decimal(28,0)")) for p in limbs(value)])


def difference(a: Column, b: Column) -> Column:
    """a - b for signed decimal texts, row by row."""
    pairs = zip(limbs(a, signed=True), limbs(b, signed=True))
    return combine([(x - y).cast("decimal(38,0)") for x, y in pairs])
