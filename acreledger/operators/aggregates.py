"""Grouped aggregates.

All of them combine on the map side, so a hot key reaches the reducer as one
row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acreledger.functions.money import money_sum
from acreledger.operators.distribution import null_safe


def sum_count(df: DataFrame, keys: Sequence[str], value: str, counted: str) -> DataFrame:
    return df.groupBy(*keys).agg(money_sum(value).alias(f"sum_{value}"), F.count(counted).alias(f"count_{counted}"))


def sum_where(value: str, condition: Column) -> Column:
    """SUM(CASE WHEN condition THEN value ELSE 0 END), exact."""
    return money_sum(F.when(condition, F.col(value)).otherwise(F.lit(0.0)))


def pivot_sums(df: DataFrame, keys: Sequence[str], value: str, cases: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[sum_where(value, cond).alias(name) for name, cond in cases.items()])


def distinct_list(df: DataFrame, keys: Sequence[str], col: str, alias: str) -> DataFrame:
    """Sorted distinct values per group, held in one row: for values that are few by nature (funds of an investor, tiers of a period)."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(col)).alias(alias))


def _one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], descending: bool) -> DataFrame:
    ranked = [*order, *[c for c in df.columns if c not in keys and c not in order]]
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) if descending else F.asc(c) for c in ranked])
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


# Fixed value: buckets of key hashes that a filter of repeated keys tells apart (at most so many rows are broadcast).
REPEATED_BUCKETS = 1 << 20


def repeated_buckets(df: DataFrame, key: str) -> DataFrame:
    """Hash buckets that hold a key with several rows; at most REPEATED_BUCKETS rows.

    Only key hashes are counted and shuffled, combined on the map side.
    """
    keys = df.groupBy(F.xxhash64(key).alias("__h")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    return keys.select(F.pmod("__h", F.lit(REPEATED_BUCKETS)).alias("__bucket")).distinct()


def deciding(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> list[str]:
    """The key and the shortest run of ranking columns that holds ``columns``.

    Copies that agree in all of these agree in ``columns`` too, so the columns
    ranked after them can't change what is kept of ``columns``.
    """
    ranked = [*order, *[c for c in df.columns if c != key and c not in order]]
    last = max((ranked.index(c) for c in columns if c != key), default=0)
    return [key, *ranked[: last + 1]]


def dedupe(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str] | None = None, counted: bool = True) -> DataFrame:
    """One row per key: the first by ``order``, then by every other column.

    ``columns``: what is wanted of the kept rows; columns that can't decide about
    these are neither read nor shuffled.

    Keys are counted first, unless ``counted`` is false: then ``df`` is read once and
    all rows are ranked, which is cheaper where ``df`` is costly to make or many keys
    repeat. Rows outside the buckets of repeated keys pass as they
    are, without a sort or shuffle; only the others are ranked. A bucket may hold
    keys that stand alone too, which ranking leaves alone: the more keys repeat,
    the more rows are ranked, up to all. ``df`` is read three times, for the key
    alone the first time; write it first if it is costly to make.

    Spark plans row_number() = 1 as a group limit before the shuffle: a map task
    passes on at most one row per key, so copies of a hot key never meet in one task.
    """
    if columns is not None:
        used = {*deciding(df, key, order, columns)}
        kept = dedupe(df.select(*[c for c in df.columns if c in used]), key, [c for c in order if c in used], counted=counted)
        return kept.select(*columns)
    if not counted:
        return _one_per_key(df, [key], order, descending=False)
    buckets = F.broadcast(repeated_buckets(df, key))
    tagged = df.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(REPEATED_BUCKETS)))
    alone = tagged.join(buckets, "__bucket", "left_anti").drop("__bucket")
    ranked = _one_per_key(tagged.join(buckets, "__bucket", "left_semi").drop("__bucket"), [key], order, descending=False)
    return alone.unionAll(ranked)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the greatest by ``order``, then by every other column."""
    return _one_per_key(df, keys, order, descending=True)


def approx_median(df: DataFrame, keys: Sequence[str], value: str, keep: Column, accuracy: int = 10_000, alias: str = "median_ms") -> DataFrame:
    """Sketched median over the rows that satisfy ``keep``; over all rows of a group where none does.

    One pass with bounded state per group; the rank error is rows / accuracy.
    """
    half = F.lit(0.5)
    return df.groupBy(*keys).agg(F.coalesce(
        F.percentile_approx(F.when(keep, F.col(value)), half, F.lit(accuracy)),
        F.percentile_approx(value, half, F.lit(accuracy))).alias(alias))


def with_group_value(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Attach group aggregates to each row: aggregate, then join back.

    Same as an unordered window, without gathering the group's rows.
    """
    totals = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return null_safe(df, totals, list(keys), "left")


def table_stats(tables: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """(table_name, row_count, last_altered) per table, unioned."""
    frames = []
    for name, (df, ts) in tables.items():
        last = F.max(F.col(ts).cast("date")) if ts else F.lit(None).cast("date")
        frames.append(df.agg(F.count(F.lit(1)).alias("row_count"), last.alias("last_altered"))
                      .select(F.lit(name).alias("table_name"), "row_count", "last_altered"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
