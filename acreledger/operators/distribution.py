"""Exact order statistics that never gather a whole group in one task.

A group may hold a third of all rows, so no step sorts or buffers a raw group:

1. rows shrink to (group, value, count) with map-side combine: a spike of equal
   values is one row from then on;
2. values fall into buckets: first by five significant digits, then each bucket
   that is too full into equal parts of the range its values really have, again
   and again, so values however close to each other part in the end;
3. a histogram gives, per group, how many rows lie before each bucket;
4. only the buckets that hold a wanted rank are opened, to single values.

Everything is a deterministic function of the data, so a task recomputed after
an executor loss agrees with the ones that survived.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acreledger.sources.storage import staged

DIGITS = 5
# Rows that one task should order, and parts that a full bucket is split into.
BUCKET_ROWS, PARTS = 100_000, 256


def coarse(v: Column, digits: int = DIGITS) -> Column:
    """Monotone cut of a double to its leading significant digits (towards zero)."""
    mag = F.abs(v)
    exponent = F.floor(F.log10(mag)).cast("double")
    decade = F.pow(F.lit(10.0), exponent)
    unit = F.pow(F.lit(10.0), exponent - F.lit(float(digits - 1)))
    # greatest(): log10 may land one decade high just below a power of ten
    cut = F.greatest(decade, F.floor(mag / unit).cast("double") * unit)
    return F.when(mag < 1e-300, F.lit(0.0)).when(v > 0, cut).otherwise(-cut)


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys where NULL matches NULL; key columns come from the left."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        eq = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = eq if cond is None else cond & eq
    if cond is None:
        raise ValueError("no join keys")
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, v, c): distinct values with their row counts and coarse bucket."""
    v = F.col(value).cast("double")
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, v.alias("__v"))
        .agg(F.count(F.lit(1)).alias("__c"))
        .withColumn("__b", coarse(F.col("__v")))
    )


def refined(units: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Write the units (keys, __v, ..., __b) and split buckets of more than BUCKET_ROWS until none can be split.

    A full bucket's values, from their least to their greatest, are dealt to PARTS
    equal ranges; the least and the greatest always part, so every round gets on.
    A part is named by where it begins, which keeps the order of the buckets.
    """
    units = staged(units, "units")
    width = (F.col("__hi") - F.col("__lo")) / F.lit(float(PARTS))
    while True:
        sizes = units.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__units"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        full = sizes.where(F.col("__units") > F.lit(BUCKET_ROWS)).withColumn("__step", width).where("__step > 0 AND __step < double('infinity')")
        if not full.take(1):
            return units
        parted = null_safe(units, staged(full.select(*keys, "__b", "__lo", "__step"), "full"), [*keys, "__b"], "left")
        begins = F.col("__lo") + F.floor((F.col("__v") - F.col("__lo")) / F.col("__step")).cast("double") * F.col("__step")
        units = staged(parted.withColumn("__b", F.coalesce(begins, F.col("__b"))).drop("__lo", "__step"), "units")


def _bucket_offsets(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, bucket): rows before the bucket, rows in it, rows of the group."""
    hist = counts.groupBy(*keys, "__b").agg(F.sum("__c").alias("__in"))
    ordered = Window.partitionBy(*keys).orderBy("__b")
    return hist.select(
        *keys, "__b", "__in",
        (F.sum("__in").over(ordered) - F.col("__in")).alias("__before"),
        F.sum("__in").over(Window.partitionBy(*keys)).alias("__n"),
    )


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ps: dict[str, float],
    discrete_upper: bool = False,
) -> DataFrame:
    """Per group, one column per entry of ``ps``: linear-interpolation percentile.

    With ``discrete_upper`` the value at rank floor(n * p) is taken instead (the
    upper median for p = 0.5).  Groups without a non-null value are absent.
    """
    keys = list(keys)
    const = [] if keys else ["__all"]
    if const:
        df = df.withColumn("__all", F.lit(1))
    ks = keys or const
    counts = refined(value_counts(df, ks, value), ks)
    offsets = _bucket_offsets(counts, ks)

    n = F.col("__n")
    wanted = []
    for name, p in ps.items():
        if discrete_upper:
            lo = F.least(F.floor(n * F.lit(p)), n - 1)
            wanted.append(F.struct(F.lit(name).alias("p"), F.lit(0).alias("side"), lo.cast("long").alias("rank")))
        else:
            pos = (n - 1).cast("double") * F.lit(p)
            lo, hi = F.floor(pos).cast("long"), F.ceil(pos).cast("long")
            wanted.append(F.struct(F.lit(name).alias("p"), F.lit(0).alias("side"), lo.alias("rank")))
            wanted.append(F.struct(F.lit(name).alias("p"), F.lit(1).alias("side"), hi.alias("rank")))
    located = (
        offsets.withColumn("__want", F.filter(
            F.array(*wanted),
            lambda w: (w["rank"] >= F.col("__before")) & (w["rank"] < F.col("__before") + F.col("__in")),
        ))
        .where(F.size("__want") > 0)
        .select(*ks, "__b", "__before", "__n", "__want")
    )
    opened = null_safe(counts, located, [*ks, "__b"])
    # a bucket holds BUCKET_ROWS values at most
    inside = Window.partitionBy(*ks, "__b").orderBy("__v")
    upto = F.col("__before") + F.sum("__c").over(inside)
    hits = (
        opened.withColumn("__upto", upto)
        .withColumn("__want", F.filter(
            "__want",
            lambda w: (w["rank"] < F.col("__upto")) & (w["rank"] >= F.col("__upto") - F.col("__c")),
        ))
        .select(*ks, "__n", "__v", F.explode("__want").alias("__w"))
    )
    aggs = [F.first("__n").alias("__n")]
    for i, name in enumerate(ps):
        for side in (0, 1):
            is_it = (F.col("__w.p") == name) & (F.col("__w.side") == side)
            aggs.append(F.max(F.when(is_it, F.col("__v"))).alias(f"__{i}_{side}"))
    sides = hits.groupBy(*ks).agg(*aggs)
    out = []
    for i, (name, p) in enumerate(ps.items()):
        lo, hi = F.col(f"__{i}_0"), F.col(f"__{i}_1")
        if discrete_upper:
            out.append(lo.alias(name))
        else:
            pos = (n - 1).cast("double") * F.lit(p)
            out.append((lo + (pos - F.floor(pos).cast("double")) * (hi - lo)).alias(name))
    return sides.select(*keys, *out)


def group_ranks(df: DataFrame, keys: Sequence[str], value: str, tiebreak: str, salts: int | None = None) -> DataFrame:
    """Add ``rank_no`` (1..n in value order) and ``group_n`` to every row.

    Same result as row_number() over the whole group, but the sorted units are
    (group, value, salt): a repeated value is spread over as many units as its
    most frequent value needs to leave BUCKET_ROWS rows to each.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    if salts is None:
        most = df.groupBy(*keys, (v + F.lit(0.0)).alias("__v")).agg(F.count(F.lit(1)).alias("__c")).agg(F.max("__c")).first()[0] or 1
        salts = -(-2 * most // BUCKET_ROWS)
    # "+ 0.0" folds -0.0 into 0.0 so that join keys and order agree
    rows = df.withColumns({
        "__v": v + F.lit(0.0),
        "__s": F.pmod(F.xxhash64(tiebreak), F.lit(salts)).cast("int"),
    })
    pieces = rows.groupBy(*keys, "__v", "__s").agg(F.count(F.lit(1)).alias("__c"))
    pieces = refined(pieces.withColumn("__b", coarse(F.col("__v"))), keys)
    offsets = _bucket_offsets(pieces, keys).select(*keys, "__b", "__before", "__n")
    inside = Window.partitionBy(*keys, "__b").orderBy("__v", "__s")
    starts = null_safe(pieces, offsets, [*keys, "__b"]).select(
        *keys, "__v", "__s", "__n",
        (F.col("__before") + F.sum("__c").over(inside) - F.col("__c")).alias("__start"),
    )
    piece = Window.partitionBy(*keys, "__v", "__s").orderBy(tiebreak)
    return (
        null_safe(rows, starts, [*keys, "__v", "__s"])
        .withColumn("rank_no", F.col("__start") + F.row_number().over(piece))
        .withColumnRenamed("__n", "group_n")
        .drop("__v", "__s", "__start")
    )


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str = "rnk") -> DataFrame:
    """rank() over (partition by keys order by value desc); ties share a rank, NULLs come last.

    Ranks are found per distinct value and joined back, so no group is sorted whole.
    """
    keys = list(keys)
    rows = df.withColumn("__v", -F.col(value).cast("double") + F.lit(0.0))
    counts = rows.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))
    filled = refined(counts.where(F.col("__v").isNotNull()).withColumn("__b", coarse(F.col("__v"))), keys)
    offsets = _bucket_offsets(filled, keys).select(*keys, "__b", "__before")
    inside = Window.partitionBy(*keys, "__b").orderBy("__v")
    ranked = null_safe(filled, offsets, [*keys, "__b"]).select(
        *keys, "__v", (F.col("__before") + F.sum("__c").over(inside) - F.col("__c") + 1).cast("int").alias(name))
    valued = F.sum(F.when(F.col("__v").isNotNull(), F.col("__c")).otherwise(F.lit(0)))
    tail = counts.groupBy(*keys).agg((valued + 1).cast("int").alias("__tail"))
    out = null_safe(null_safe(rows, ranked, [*keys, "__v"], "left"), tail, keys, "left")
    return out.withColumn(name, F.coalesce(F.col(name), F.col("__tail"))).drop("__v", "__tail")
