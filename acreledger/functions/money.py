"""Exact money arithmetic.

Amounts are doubles in the data model.  Sums run over integer cents, so a total
does not depend on the order in which partitions are merged; the result goes
back to a double once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(c: Column | str, scale: int = 100) -> Column:
    """Half-up integer units of ``1/scale``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * F.lit(float(scale)) + F.lit(0.5)).cast("long")


def from_cents(c: Column, scale: int = 100) -> Column:
    return c.cast("double") / F.lit(float(scale))


def money_sum(c: Column | str, scale: int = 100) -> Column:
    """Sum of a keyed group; the long buffer holds 9.2e16 currency units."""
    return from_cents(F.sum(cents(c, scale)), scale)


def money_total(c: Column | str, scale: int = 100) -> Column:
    """Grand total over a whole table: decimal buffer, cannot overflow a long."""
    return from_cents(F.sum(cents(c, scale).cast("decimal(20,0)")), scale)


def money_avg(c: Column | str, scale: int = 100) -> Column:
    """Mean of amounts, exact up to the final division."""
    return F.sum(cents(c, scale)).cast("double") / F.count(c).cast("double") / F.lit(float(scale))


def round_half_up(c: Column, digits: int) -> Column:
    """Decimal rounding with the same answer for every merge order."""
    f = float(10**digits)
    return F.floor(c * F.lit(f) + F.lit(0.5)).cast("double") / F.lit(f)


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, NULL where the denominator is zero."""
    return num / F.when(den != 0, den)
