"""Windows, top-k, custom orders, samples and unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_within(df: DataFrame, part: Sequence[str], order: Sequence[Column], name: str = "rnk") -> DataFrame:
    return df.withColumn(name, F.rank().over(Window.partitionBy(*part).orderBy(*order)))


def top_per_group(df: DataFrame, part: Sequence[str], order: Sequence[Column], k: int, name: str = "rnk") -> DataFrame:
    """rank() <= k; Spark cuts each map task to its own top k before the shuffle."""
    return rank_within(df, part, order, name).where(F.col(name) <= k)


def first_per_group(df: DataFrame, part: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """row_number() = 1 with a total order (the group limit is applied map-side)."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def lag_within(df: DataFrame, part: Sequence[str], order: Sequence[str], col: str, name: str) -> DataFrame:
    return df.withColumn(name, F.lag(col).over(Window.partitionBy(*part).orderBy(*order)))


def running_sum(df: DataFrame, part: Sequence[str], order: str, col: str, name: str) -> DataFrame:
    """Cumulative sum in cents over the default RANGE frame (peers share a total)."""
    from acreledger.functions.money import cents, from_cents

    w = Window.partitionBy(*part).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, from_cents(F.sum(cents(col)).over(w)))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def case_order(col: str, order: Sequence[str]) -> Column:
    """Position of the value in a fixed list; others come last."""
    expr = F.when(F.col(col) == order[0], F.lit(1))
    for i, v in enumerate(order[1:], start=2):
        expr = expr.when(F.col(col) == v, F.lit(i))
    return expr.otherwise(F.lit(len(order) + 1))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n pseudo-random rows that do not depend on partitioning: smallest seeded digests of the key."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key), F.lit(seed))), F.col(key)).limit(n)


def id_pool(df: DataFrame, col: str, n: int = 500) -> DataFrame:
    return df.select(col).distinct().orderBy(col).limit(n)


def union_tagged(frames: dict[str, DataFrame], tag: str) -> DataFrame:
    """Union of equally shaped frames with a literal column naming the source."""
    return reduce(DataFrame.unionByName, [df.withColumn(tag, F.lit(name)) for name, df in frames.items()])


def union_padded(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by name; columns missing on one side become NULL."""
    return a.unionByName(b, allowMissingColumns=True)
