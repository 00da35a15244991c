"""Analytics over workload result tables (runs, summary, raw samples, buckets)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreledger.functions.money import money_avg, money_sum, round_half_up, safe_ratio
from acreledger.operators.aggregates import with_group_value
from acreledger.operators.distribution import group_ranks, null_safe
from acreledger.operators.distribution import percentiles as exact_percentiles
from acreledger.operators.ordering import first_per_group
from acreledger.operators.predicates import measured

SUMMARY_KEYS = ["run_id", "target", "concurrency", "query_name"]
PERCENTILES = {"p50_ms": 0.50, "p95_ms": 0.95, "p99_ms": 0.99}
# Service levels in ms, and the mark of a query that never finished.
SLO_MS = {"p50_ms": 4000.0, "p95_ms": 5000.0, "p99_ms": 7000.0}
DNF_MS = 7_200_000.0
MICRO = 1_000_000


def percentiles(df: DataFrame, keys: Sequence[str], latency: str, ps: dict[str, float]) -> DataFrame:
    """Interpolated percentiles in ms, given to the nanosecond."""
    out = exact_percentiles(df, keys, latency, ps)
    return out.withColumns({name: round_half_up(F.col(name), 6) for name in ps})


# ------------------------------------------------------------ run selection
def latest_run(rows: DataFrame, runs: DataFrame, mode: str) -> DataFrame:
    """Rows of the most recent run of a mode (a scalar subquery, so it can prune partitions)."""
    newest = runs.where(F.col("mode") == mode).orderBy(F.desc("started_on"), "run_id").limit(1).select("run_id")
    return rows.where(F.col("run_id") == newest.scalar())


def latest_run_rows(summary: DataFrame, runs: DataFrame, raw: DataFrame, mode: str = "sustained") -> DataFrame:
    """Samples of the latest run per (query, rate)."""
    per_rate = summary.select("run_id", "query_name").distinct().join(runs.where(F.col("mode") == mode), "run_id")
    keep = first_per_group(per_rate, ["query_name", "target_rate_qps"], [F.desc("started_on"), F.col("run_id")])
    return raw.join(keep.select("run_id", "query_name", "target_rate_qps"), ["run_id", "query_name"])


def lockstep_view(summary: DataFrame, runs: DataFrame) -> DataFrame:
    """Summaries of lockstep runs; runs without a mode count as lockstep."""
    lockstep = runs.where(F.coalesce("mode", F.lit("lockstep")) == "lockstep").select("run_id")
    return summary.join(lockstep, "run_id").select(
        "run_id", "target", "concurrency", "query_name", "p50_ms", "p95_ms", "p99_ms", "mean_ms", "throughput_qps", "error_rate")


def raw_recent(raw: DataFrame, runs: DataFrame, as_of: str, days: int = 7, k: int = 50_000) -> DataFrame:
    recent = runs.where(
        (F.coalesce("mode", F.lit("lockstep")) == "lockstep") & (F.col("started_on") >= F.date_sub(F.lit(as_of).cast("date"), days))
    ).select("run_id", "started_on")
    return (
        raw.join(recent, "run_id").orderBy(F.desc("started_on"), "iteration").limit(k)
        .select("target", "concurrency", "query_name", "run_id", "iteration", "latency_ms")
    )


# ------------------------------------------------------------ summaries
def _stats(rows: DataFrame, keys: Sequence[str], latency: str) -> DataFrame:
    ok = F.col("success") & F.col(latency).isNotNull()
    lat = F.when(ok, F.col(latency))
    counts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.count_if(F.col("success")).alias("successful"),
        F.min(lat).alias("min_ms"), F.max(lat).alias("max_ms"), money_avg(lat).alias("mean_ms"),
    )
    ranks = percentiles(rows.where(ok), keys, latency, PERCENTILES)
    out = null_safe(counts, ranks, list(keys))  # groups without a success drop out
    failed = F.col("total_queries") - F.col("successful")
    return out.withColumns({"failed": failed, "error_rate": failed.cast("double") / F.col("total_queries").cast("double")})


def lockstep_throughput() -> Column:
    """ok / (slowest latency x number of lockstep rounds)."""
    rounds = F.greatest(F.lit(1), F.expr("total_queries div greatest(1, concurrency)"))
    wall = F.greatest(F.col("max_ms") / F.lit(1000.0) * rounds.cast("double"), F.lit(0.001))
    return F.col("successful").cast("double") / wall


def summary_lockstep(raw: DataFrame, keys: Sequence[str] = SUMMARY_KEYS) -> DataFrame:
    return _stats(raw, keys, "latency_ms").withColumn("throughput_qps", lockstep_throughput())


def summary_sustained(raw: DataFrame, duration_s: float, keys: Sequence[str] = ("run_id", "target", "query_name")) -> DataFrame:
    """Over queue + execution time, warm-up excluded."""
    out = _stats(raw.where(~F.col("is_warmup")), keys, "total_latency_ms")
    return out.withColumn("throughput_qps", F.col("successful").cast("double") / F.lit(float(duration_s)))


def timeseries(raw: DataFrame, bucket_s: int, warmup_s: int, total_s: int, keys: Sequence[str] = ("run_id", "target")) -> DataFrame:
    """Tumbling buckets by start offset, up to the end of the last one begun; buckets without a success are absent."""
    last_s = -(-total_s // bucket_s) * bucket_s
    rows = raw.where(F.col("actual_start_offset_ms") < last_s * 1000).withColumn(
        "bucket_start_offset_s", F.floor(F.col("actual_start_offset_ms") / F.lit(bucket_s * 1000.0)).cast("int") * bucket_s)
    by = [*keys, "bucket_start_offset_s"]
    ok = F.col("success") & F.col("total_latency_ms").isNotNull()
    counts = rows.groupBy(*by).agg(
        F.max(F.when(ok, F.col("total_latency_ms"))).alias("max_ms"),
        (F.count_if(F.col("success")).cast("double") / F.lit(float(bucket_s))).alias("achieved_qps"),
        F.count_if(~F.col("success")).alias("error_count"),
    )
    ranks = percentiles(rows.where(ok), by, "total_latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95})
    end = F.col("bucket_start_offset_s") + bucket_s
    return null_safe(counts, ranks, by).withColumns({
        "query_name": F.lit("__all__"),
        "bucket_end_offset_s": F.least(end, F.lit(total_s)),
        "is_warmup": end <= warmup_s,
    })


def headline(summary: DataFrame, runs: DataFrame, exclude: str, mode: str = "sustained") -> DataFrame:
    """Median P95/P99 over queries per run and target, without the worst-case query.

    If only that query ran, its own median is used.
    """
    keys = ["run_id", "target"]
    totals = summary.groupBy(*keys).agg(
        F.max("p95_ms").alias("p95_max_ms"), F.sum("successful").alias("total_samples"), F.sum("failed").alias("total_failures"))
    # both percentiles, with and without the worst query, as one keyed set: a single pass finds the four medians
    shapes = F.explode(F.array(*(F.struct(F.lit(f"{c}_{k}").alias("__kind"), F.when(keep, F.col(f"{c}_ms")).alias("__ms"))
                                 for c in ("p95", "p99") for k, keep in (("mix", F.col("query_name") != exclude), ("any", F.lit(True))))))
    stacked = summary.select(*keys, shapes.alias("__s")).select(*keys, "__s.*").where("__ms IS NOT NULL")
    medians = percentiles(stacked, [*keys, "__kind"], "__ms", {"__median": 0.5})
    flat = medians.groupBy(*keys).agg(*(F.coalesce(*(F.max(F.when(F.col("__kind") == f"{c}_{k}", F.col("__median"))) for k in ("mix", "any"))).alias(f"{c}_median_ms") for c in ("p95", "p99")))
    totals = null_safe(totals, flat, keys, "left")
    return runs.where(F.col("mode") == mode).select("run_id", "started_on", "target_rate_qps").join(totals, "run_id", "left")


def latest_headline(summary: DataFrame, runs: DataFrame, names: Sequence[str], mode: str = "sustained") -> DataFrame:
    """Latest sustained summary per (query, target)."""
    rows = summary.where(F.col("query_name").isin(list(names))).join(
        runs.where(F.col("mode") == mode).select("run_id", "started_on", "target_rate_qps"), "run_id")
    return first_per_group(rows, ["query_name", "target"], [F.desc("started_on"), F.col("concurrency")]).select(
        "query_name", "target", "p50_ms", "p95_ms", "p99_ms", "mean_ms", "successful", "failed", "target_rate_qps", "run_id")


def latest_samples(summary: DataFrame, runs: DataFrame, raw: DataFrame, names: Sequence[str]) -> DataFrame:
    rows = latest_run_rows(summary.where(F.col("query_name").isin(list(names))), runs, raw)
    return rows.where(F.col("success") & ~F.col("is_warmup")).select(
        "query_name", "target_rate_qps", "iteration", "latency_ms", "queue_time_ms", "total_latency_ms",
        "scheduled_arrival_offset_ms", "actual_start_offset_ms")


def worst_case_latest(summary: DataFrame, runs: DataFrame, name: str, target: str) -> DataFrame:
    rows = summary.where((F.col("query_name") == name) & (F.col("target") == target)).join(
        runs.where(F.col("mode") == "sustained").select("run_id", "started_on"), "run_id")
    return rows.orderBy(F.desc("started_on"), "concurrency").limit(1).select("p50_ms", "p95_ms", "p99_ms", "mean_ms")


def warmup_samples(raw: DataFrame, runs: DataFrame) -> DataFrame:
    return latest_run(raw, runs, "sustained").where("is_warmup").orderBy("target", "actual_start_offset_ms", "iteration").select(
        "target", "query_name", "iteration", "actual_start_offset_ms", "queue_time_ms", "latency_ms", "total_latency_ms", "success")


# ------------------------------------------------------------ chart-side rollups
def mix_mean(summary: DataFrame, exclude: str, metric: str = "p95_ms") -> DataFrame:
    return summary.where(F.col("query_name") != exclude).groupBy("target", "concurrency").agg(money_avg(metric, MICRO).alias(metric))


def mix_throughput(summary: DataFrame, exclude: str) -> DataFrame:
    return summary.where(F.col("query_name") != exclude).groupBy("target", "concurrency").agg(
        money_sum("throughput_qps", MICRO).alias("throughput_qps"))


def top_concurrency(summary: DataFrame) -> DataFrame:
    return summary.where(F.col("concurrency") == summary.agg(F.max("concurrency")).scalar())


def cdf(raw: DataFrame, part: str = "target") -> DataFrame:
    """Cumulative percentage of measured samples per series, one row per sample."""
    ranked = group_ranks(measured(raw).select(part, "total_latency_ms", "iteration"), [part], "total_latency_ms", "iteration")
    return ranked.select(part, "total_latency_ms", (F.col("rank_no").cast("double") / F.col("group_n").cast("double") * F.lit(100.0)).alias("cdf"))


def timeline(samples: DataFrame, series: Sequence[str]) -> DataFrame:
    """Seconds since the series' first arrival, with the series' P95 on each row."""
    rows = with_group_value(samples, series, __t0=F.min("scheduled_arrival_offset_ms"))
    p95 = percentiles(samples, list(series), "latency_ms", {"series_p95_ms": 0.95})
    return null_safe(rows, p95, list(series), "left").withColumn(
        "elapsed_s", (F.col("scheduled_arrival_offset_ms") - F.col("__t0")) / F.lit(1000.0)).drop("__t0")


def slo_check(summary: DataFrame, slo: dict[str, float] = SLO_MS) -> DataFrame:
    met = {f"{c}_met": F.col(c) <= F.lit(limit) for c, limit in slo.items()}
    every = None
    for cond in met.values():
        every = cond if every is None else every & cond
    return summary.withColumns({**met, "slo_met": every})


def speedup(rows: DataFrame, base: str, other: str, dnf_ms: float = DNF_MS) -> DataFrame:
    """P95 of the base query over P95 of the other, per target; DNF past the limit."""
    wide = rows.groupBy("target").agg(
        F.max(F.when(F.col("query_name") == base, F.col("p95_ms"))).alias("base_p95_ms"),
        F.max(F.when(F.col("query_name") == other, F.col("p95_ms"))).alias("other_p95_ms"),
    )
    finished = F.col("base_p95_ms") < dnf_ms
    return wide.withColumns({
        "speedup": F.when(finished, safe_ratio(F.col("base_p95_ms"), F.col("other_p95_ms"))),
        "outcome": F.when(F.col("base_p95_ms").isNull() | F.col("other_p95_ms").isNull(), "pending").when(finished, "ok").otherwise("DNF"),
    })


def percentile_rows(rows: DataFrame) -> DataFrame:
    return rows.unpivot(["query_name", "target"], list(PERCENTILES), "percentile", "value_ms")


def qps_gap(buckets: DataFrame, runs: DataFrame) -> DataFrame:
    """Achieved against target rate per bucket."""
    joined = buckets.join(runs.select("run_id", "target_rate_qps"), "run_id")
    return joined.select("run_id", "target", "bucket_start_offset_s", "is_warmup", "achieved_qps", "target_rate_qps",
                         (F.col("target_rate_qps") - F.col("achieved_qps")).alias("qps_gap"),
                         (F.col("achieved_qps") >= F.col("target_rate_qps")).alias("kept_pace"))


def run_id_of(stamp: Column) -> Column:
    """Run id of a result directory: 20240105_101530 -> 2024-01-05T10:15:30Z."""
    return F.date_format(F.to_timestamp(stamp, "yyyyMMdd_HHmmss"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def derive_runs(raw: DataFrame, dir_col: str = "run_dir", tail_s: int = 30) -> DataFrame:
    """Run rows rebuilt from samples.  The directory stamp yyyyMMdd_HHmmss is the start (UTC)."""
    started = F.to_timestamp(F.col(dir_col), "yyyyMMdd_HHmmss")
    offsets = raw.groupBy(dir_col).agg(
        F.array_sort(F.collect_set("target")).alias("targets"),
        F.max(F.coalesce("actual_start_offset_ms", F.lit(0.0))).alias("__max_ms"),
    )
    return offsets.select(
        run_id_of(F.col(dir_col)).alias("run_id"), started.alias("started_at"), "targets",
        F.timestamp_seconds(F.unix_seconds(started) + F.floor(F.col("__max_ms") / F.lit(1000.0)) + tail_s).alias("ended_at"),
    )


def median_compare(samples: DataFrame, base: str, other: str) -> DataFrame:
    """Upper median per query and target, and the ratio between two targets."""
    med = exact_percentiles(samples, ["query_name", "target"], "latency_ms", {"median_ms": 0.5}, discrete_upper=True)
    wide = med.groupBy("query_name").agg(
        F.max(F.when(F.col("target") == base, F.col("median_ms"))).alias("base_ms"),
        F.max(F.when(F.col("target") == other, F.col("median_ms"))).alias("other_ms"),
    )
    return wide.withColumn("speedup", safe_ratio(F.col("base_ms"), F.col("other_ms")))
