"""Headline timings: one medallion update, then the workload over the written tables.

Prints one JSON line.  Every query runs over its whole input and is evaluated in
full (noop sink); ``medallion_update`` is the build of all silver and gold tables.
"""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from acreledger.testbed import catalog
from acreledger.testbed.registry import Context

HEADLINE = [
    "gold_fund_performance", "gold_property_financials", "gold_investor_portfolio", "gold_gl_monthly_summary", "gold_arena_overview",
    "q1_fund_performance_arena", "q2_gl_monthly_by_arena_year", "q3_property_financials_joined", "q4_top10_properties",
    "q5_pnl_rollup_multi_month", "q6_investor_commitments", "q7_yoy_growth",
    "q8_fund_rollup", "gold_fund_attribution_period", "q8_refactored", "q8a_pcap_statement", "gold_investor_pcap", "q8a_refactored",
    "dash_noi_trend", "dash_top_properties", "ask_portfolio_summary", "pub_snapshot_diff",
    "lat_summary", "lat_timeseries_30s", "lat_headline", "lat_cdf", "st_gl_monthly",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
    )
    if not os.environ.get("SPARK_CHECKPOINT_DIR"):
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()

    times: dict[str, float] = {}
    start = time.perf_counter()
    Context(spark, sf_dir).lake.update()
    times["medallion_update"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
