"""Row filters.  Parameters travel as literals, never as spliced SQL text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def as_date(d) -> Column:
    return F.lit(d).cast("date") if isinstance(d, str) else F.lit(d)


def tenant_eq(df: DataFrame, col: str, value: str) -> DataFrame:
    return df.where(F.col(col) == F.lit(value))


def trailing_months(df: DataFrame, col: str, months: int, as_of) -> DataFrame:
    return df.where(F.col(col) >= F.add_months(as_date(as_of), -months))


def lookback(df: DataFrame, ts_col: str, interval: str, as_of: str) -> DataFrame:
    """Rows no older than ``interval`` (e.g. '7 DAYS') before ``as_of``."""
    start = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {interval}")
    return df.where(F.col(ts_col) >= start)


def between(df: DataFrame, col: str, lo, hi) -> DataFrame:
    return df.where(F.col(col).between(lo, hi))


def up_to(df: DataFrame, col: str, as_of) -> DataFrame:
    return df.where(F.col(col) <= as_date(as_of))


def in_list(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    return df.where(F.col(col).isin(list(values)))


def in_subquery(df: DataFrame, sub: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(sub, on, "left_semi")


def like_prefix(df: DataFrame, col: str, prefix: str) -> DataFrame:
    return df.where(F.col(col).startswith(prefix))


def ilike_any(df: DataFrame, col: str, patterns: Sequence[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [F.col(col).ilike(p) for p in patterns]))


def text_of(df: DataFrame, col: str) -> Column:
    """A column as searchable text: nested values become JSON."""
    kind = df.schema[col].dataType.typeName()
    return F.to_json(F.col(col)) if kind in ("struct", "map", "array") else F.col(col).cast("string")


def contains_any(df: DataFrame, cols: Sequence[str], needle: str) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [text_of(df, c).contains(needle) for c in cols]))


def exclude_prefixes(df: DataFrame, col: str, prefixes: Sequence[str]) -> DataFrame:
    for p in prefixes:
        df = df.where(~F.col(col).startswith(p))
    return df


def optional_params(df: DataFrame, params: dict[str, tuple[str, object]]) -> DataFrame:
    """``{column: (op, value)}``; a value of None leaves the column unfiltered."""
    ops = {"=": lambda c, v: c == v, ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v}
    for col, (op, value) in params.items():
        if value is not None:
            df = df.where(ops[op](F.col(col), F.lit(value)))
    return df


def default_eq(df: DataFrame, col: str, default, value) -> DataFrame:
    return df.where(F.coalesce(F.col(col), F.lit(default)) == F.lit(value))


def measured(df: DataFrame, latency: str = "total_latency_ms") -> DataFrame:
    return df.where(F.col("success") & ~F.col("is_warmup") & F.col(latency).isNotNull())


def expect_or_drop(df: DataFrame, rules: dict[str, str], observation: Observation | str | None = None) -> DataFrame:
    """Keep rows that meet every rule; count violations per rule on the way.

    The counts ride along as observed metrics, so no second pass is needed.
    Works on batch and streaming frames.
    """
    holds = {name: F.coalesce(F.expr(rule), F.lit(False)) for name, rule in rules.items()}
    if observation is not None:
        df = df.observe(observation, *[F.count_if(~ok).alias(name) for name, ok in holds.items()])
    return df.where(reduce(lambda a, b: a & b, holds.values()))


def violation_counts(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """One row per rule: rule, rows that break it."""
    counts = df.agg(*[F.count_if(~F.coalesce(F.expr(r), F.lit(False))).alias(n) for n, r in rules.items()])
    return counts.unpivot([], list(rules), "rule", "violations")
