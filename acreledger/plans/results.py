"""Loading result directories into the four workload tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acreledger import schemas
from acreledger.plans.latency import derive_runs, run_id_of
from acreledger.sources.readers import read_results_csv
from acreledger.sources.writers import replace_by_key

# File names of a result directory and the tables they load.
FILES = {
    "benchmark_raw": ("raw_results.csv", schemas.BENCHMARK_RAW),
    "benchmark_summary": ("summary.csv", schemas.BENCHMARK_SUMMARY),
    "benchmark_summary_timeseries": ("timeseries_buckets.csv", schemas.BENCHMARK_TIMESERIES),
}


def load_results(spark: SparkSession, results_dir: str, out: str, scenario: str, rate_qps: float, duration_s: int = 600,
                 warmup_s: int = 90, arrival: str = "poisson", workspace: str = "", with_buckets: bool = True) -> DataFrame:
    """Load one sustained run; loading it again replaces its rows.  Returns the run row.

    The directory is named by the run's start, yyyyMMdd_HHmmss in UTC.
    """
    stamp = results_dir.rstrip("/").rsplit("/", 1)[-1]
    frames = {}
    for table, (file, schema) in FILES.items():
        if table == "benchmark_summary_timeseries" and not with_buckets:
            continue
        rows = read_results_csv(spark, f"{results_dir.rstrip('/')}/{file}", schema)
        frames[table] = rows.withColumn("run_id", run_id_of(F.lit(stamp)))
    run = derive_runs(frames["benchmark_raw"].withColumn("run_dir", F.lit(stamp))).withColumns({
        "git_sha": F.lit(""), "workspace": F.lit(workspace), "concurrency_levels": F.array().cast("array<int>"),
        "iterations": F.lit(0), "warmup": F.lit(0), "notes": F.lit(f"{scenario} (loaded from {stamp})"), "mode": F.lit("sustained"),
        "target_rate_qps": F.lit(float(rate_qps)), "arrival_distribution": F.lit(arrival), "duration_seconds": F.lit(duration_s),
        "warmup_seconds": F.lit(warmup_s),
    })
    frames["benchmark_runs"] = run.select(*schemas.BENCHMARK_RUNS.fieldNames())
    for table, df in frames.items():
        replace_by_key(df, f"{out}/{table}", "run_id")
    return frames["benchmark_runs"]
