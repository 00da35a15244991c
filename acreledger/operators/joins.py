"""Join shapes of the ledger reports.

Nothing is force-broadcast: Spark picks a broadcast from measured sizes
(autoBroadcastJoinThreshold, and again at run time under AQE), and splits a hot
key of a shuffled join otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def left_equi(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    """Left join to a side with one row per key (a dimension or an aggregate)."""
    return left.join(right, on, "left")


def left_many(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    """Left join to a side with many rows per key.

    A hot key on the right of an outer join cannot be split.  Matches come from an
    inner join, where AQE splits either side; rows without one from an anti-join
    against the distinct keys.
    """
    keys = [on] if isinstance(on, str) else list(on)
    missing = left.join(right.select(*keys).distinct(), keys, "left_anti")
    return left.join(right, keys).unionByName(missing, allowMissingColumns=True)


def inner_equi(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    return left.join(right, on, "inner")


def snowflake(fact: DataFrame, dims: Sequence[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """Chain of (dim, fact column, dim key, how); the dim key is not kept."""
    for dim, fact_col, dim_key, how in dims:
        keyed = dim.withColumnRenamed(dim_key, "__dim_key")
        fact = fact.join(keyed, F.col(fact_col) == F.col("__dim_key"), how).drop("__dim_key")
    return fact


def left_before(left: DataFrame, right: DataFrame, on: list[str], date_col: str, before) -> DataFrame:
    """Left join whose ON clause also says right.date < before."""
    return left_many(left, right.where(F.col(date_col) < before), on)


def attach_literal(left: DataFrame, ref: DataFrame, key: str, code, how: str = "left") -> DataFrame:
    """ON right.key = literal.  ``key`` is the reference's primary key, so one row is attached."""
    return attach_all(left, ref.where(F.col(key) == F.lit(code)).drop(key), how)


def attach_all(left: DataFrame, small: DataFrame, how: str = "inner") -> DataFrame:
    """Every left row with every row of a set that is small by nature: reference rows, one-row aggregates, calendar windows.

    Spark chooses the plan from the measured size; no size fails or loses rows.
    """
    return left.join(small, F.lit(True), how)


def attach_top1(left: DataFrame, right: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Left-join the single first row of the right side."""
    return attach_all(left, right.orderBy(*order).limit(1), "left")


def role_playing(fact: DataFrame, dim: DataFrame, key: str, roles: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Join one dim several times: ``{prefix: (fact column, dim columns)}``."""
    for prefix, (fact_col, cols) in roles.items():
        side = dim.select(F.col(key).alias(f"__{prefix}"), *[F.col(c).alias(f"{prefix}_{c}") for c in cols])
        fact = fact.join(side, F.col(fact_col) == F.col(f"__{prefix}")).drop(f"__{prefix}")
    return fact


def join_parts(base: DataFrame, parts: Sequence[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Left-join parts that are already aggregated to the join grain."""
    for part, keys in parts:
        base = base.join(part, keys, "left")
    return base
