"""Column builders shared by the conform and rollup jobs."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ledger categories counted as expense.
EXPENSE_CATEGORIES = ["opex", "capex", "debt_service"]


def is_expense(category: Column) -> Column:
    return category.isin(EXPENSE_CATEGORIES)


def lower_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.lower(F.col(c)) for c in cols})


def cast_or_null(c: Column, to: str) -> Column:
    """Typed value of raw text; unparseable text is NULL, not an error."""
    return c.try_cast(to)


def month_start(c: Column) -> Column:
    """First day of the month as a timestamp (internal form of `month`)."""
    return F.date_trunc("month", c)


def month_date(c: Column) -> Column:
    return F.trunc(c, "month")


def period_label(d: Column) -> Column:
    """FY2024_Q1; sorts chronologically as text."""
    return F.concat(F.lit("FY"), F.year(d), F.lit("_Q"), F.quarter(d))


def quarter_number(period_id: Column) -> Column:
    """Quarters since year zero of a period label."""
    return F.substring(period_id, 3, 4).cast("int") * 4 + F.substring(period_id, 9, 1).cast("int")


def case_ladder(value: Column, cuts: Sequence[Column], labels: Sequence[str]) -> Column:
    """First label whose cut is at or above the value, else the last label."""
    expr = F.when(value <= cuts[0], F.lit(labels[0]))
    for cut, label in zip(cuts[1:], labels[1:-1]):
        expr = expr.when(value <= cut, F.lit(label))
    return expr.otherwise(F.lit(labels[-1]))


def power_proxy(ratio: Column, exponent: float = 0.25) -> Column:
    """ratio ** exponent - 1; NULL for a negative ratio."""
    return F.when(ratio >= 0, F.pow(ratio, F.lit(exponent)) - 1)


def bytes_to_mb(c: Column) -> Column:
    return c.cast("double") / F.lit(1024.0) / F.lit(1024.0)


def concat_key(*cols: str, sep: str = ".") -> Column:
    return F.concat_ws(sep, *cols)


def padded_id(prefix: str, key: Column, width: int) -> Column:
    """Zero-padded id; a key wider than the pad keeps all its digits."""
    text = key.cast("string")
    return F.concat(F.lit(f"{prefix}-"), F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0")))


def pick_by_key(key: Column, values: Sequence) -> Column:
    """The value at the key's place, counted round the list; negative keys count too."""
    choices = F.array(*map(F.lit, values))
    return F.get(choices, F.pmod(key, F.lit(len(values))).cast("int"))


def pick_by_share(u: Column, shares: dict) -> Column:
    """The value in whose share of [0, 1) u falls; ``shares`` gives each value its size, summing to one."""
    edges = list(accumulate(shares.values()))
    if abs(edges[-1] - 1.0) > 1e-9:
        raise ValueError("shares must sum to one")
    passed = F.size(F.filter(F.array(*map(F.lit, edges[:-1])), lambda edge: edge <= u))
    return F.element_at(F.array(*map(F.lit, shares)), passed + 1)


def memo_text(account: Column, amount: Column, counterparty: Column, is_long: Column) -> Column:
    """Templated memo; a share of rows carries a long narrative."""
    base = F.concat_ws(" ", F.lit("Posting"), account, F.lit("of"), F.format_number(F.abs(amount), 2), F.lit("with"), counterparty)
    return F.when(is_long, F.concat(base, F.lit(". "), F.repeat(F.lit("Supporting detail retained on file. "), 8))).otherwise(base)


def clamp(c: Column, lo, hi) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def joined_set(c: Column, sep: str = ", ") -> Column:
    """Set of names as one text, in name order."""
    return F.concat_ws(sep, F.array_sort(c))


def json_field(c: Column, path: str) -> Column:
    return F.get_json_object(c, path)
