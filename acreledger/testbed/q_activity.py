"""Workload-latency, audit, usage and catalog queries and oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from acreledger.plans import audit, integrity, latency
from acreledger.testbed.registry import c, define, mavg, query, rnd

# ------------------------------------------------------------ summaries
STATS = """COUNT(*) AS total_queries, COUNT(*) FILTER (success) AS successful,
  MIN({l}) FILTER (success) AS min_ms, MAX({l}) FILTER (success) AS max_ms,
  CAST(SUM({cl}) FILTER (success) AS DOUBLE) / CAST(COUNT({l}) FILTER (success) AS DOUBLE) / 100e0 AS mean_ms,
  floor(quantile_cont({l}, 0.5) FILTER (success) * 1000000e0 + 5e-1) / 1000000e0 AS p50_ms,
  floor(quantile_cont({l}, 0.95) FILTER (success) * 1000000e0 + 5e-1) / 1000000e0 AS p95_ms,
  floor(quantile_cont({l}, 0.99) FILTER (success) * 1000000e0 + 5e-1) / 1000000e0 AS p99_ms"""
define("bsummary_base", f"""SELECT *, total_queries - successful AS failed,
    CAST(total_queries - successful AS DOUBLE) / CAST(total_queries AS DOUBLE) AS error_rate FROM (
  SELECT run_id, target, concurrency, query_name, {STATS.format(l="latency_ms", cl=c("latency_ms"))}
  FROM benchmark_raw GROUP BY 1, 2, 3, 4) s WHERE successful > 0""")
define("bsummary", """SELECT *, CAST(successful AS DOUBLE) / greatest(max_ms / 1000e0 * CAST(greatest(1, total_queries // concurrency) AS DOUBLE), 1e-3)
  AS throughput_qps FROM bsummary_base""")
define("bbuckets", f"""SELECT run_id, target, '__all__' AS query_name, bucket_start_offset_s,
    least(bucket_start_offset_s + 30, 86400) AS bucket_end_offset_s, p50_ms, p95_ms, max_ms, achieved_qps, error_count,
    bucket_start_offset_s + 30 <= 7200 AS is_warmup FROM (
  SELECT run_id, target, CAST(floor(actual_start_offset_ms / 30000e0) AS INT) * 30 AS bucket_start_offset_s,
    {rnd("quantile_cont(total_latency_ms, 0.5) FILTER (success)", 6)} AS p50_ms, {rnd("quantile_cont(total_latency_ms, 0.95) FILTER (success)", 6)} AS p95_ms,
    MAX(total_latency_ms) FILTER (success) AS max_ms, CAST(COUNT(*) FILTER (success) AS DOUBLE) / 30e0 AS achieved_qps,
    COUNT(*) FILTER (NOT success) AS error_count, COUNT(*) FILTER (success) AS ok
  FROM benchmark_raw WHERE actual_start_offset_ms < 86400000 GROUP BY 1, 2, 3) b WHERE ok > 0""")

WORST, NAMES = "error", ["click", "view"]


def summary(x):
    """The summary table as the result loader stores it: written once, then read."""
    return x.lake.table("benchmark_summary")


def buckets(x):
    return latency.timeseries(x.t.benchmark_raw, 30, 7200, 86400)


query("lat_summary", "SELECT * EXCLUDE (throughput_qps) FROM bsummary")(
    lambda x: latency.summary_lockstep(x.t.benchmark_raw).drop("throughput_qps"))
query("lat_throughput_lockstep", "SELECT run_id, target, concurrency, query_name, throughput_qps FROM bsummary")(
    lambda x: summary(x).select("run_id", "target", "concurrency", "query_name", "throughput_qps"))
query("lat_throughput_sustained", f"""SELECT *, total_queries - successful AS failed,
    CAST(total_queries - successful AS DOUBLE) / CAST(total_queries AS DOUBLE) AS error_rate, CAST(successful AS DOUBLE) / 79200e0 AS throughput_qps FROM (
  SELECT run_id, target, query_name, {STATS.format(l="total_latency_ms", cl=c("total_latency_ms"))}
  FROM benchmark_raw WHERE NOT is_warmup GROUP BY 1, 2, 3) s WHERE successful > 0""")(
    lambda x: latency.summary_sustained(x.t.benchmark_raw, 79200))
query("lat_timeseries_30s", "SELECT * FROM bbuckets")(buckets)
query("lat_headline", f"""SELECT r.run_id, started_on, target_rate_qps, target, p95_max_ms, total_samples, total_failures, p95_median_ms, p99_median_ms
  FROM benchmark_runs r LEFT JOIN (SELECT run_id, target, MAX(p95_ms) AS p95_max_ms, CAST(SUM(successful) AS BIGINT) AS total_samples,
    CAST(SUM(failed) AS BIGINT) AS total_failures,
    floor(COALESCE(quantile_cont(p95_ms, 0.5) FILTER (query_name <> '{WORST}'), quantile_cont(p95_ms, 0.5)) * 1000000e0 + 5e-1) / 1000000e0 AS p95_median_ms,
    floor(COALESCE(quantile_cont(p99_ms, 0.5) FILTER (query_name <> '{WORST}'), quantile_cont(p99_ms, 0.5)) * 1000000e0 + 5e-1) / 1000000e0 AS p99_median_ms
    FROM bsummary GROUP BY 1, 2) h ON h.run_id = r.run_id WHERE r.mode = 'sustained'""")(
    lambda x: latency.headline(summary(x), x.t.benchmark_runs, WORST))
query("lat_lockstep_view", """SELECT s.run_id, target, concurrency, query_name, p50_ms, p95_ms, p99_ms, mean_ms, throughput_qps, error_rate
  FROM bsummary s JOIN benchmark_runs r ON r.run_id = s.run_id WHERE COALESCE(mode, 'lockstep') = 'lockstep'""")(
    lambda x: latency.lockstep_view(summary(x), x.t.benchmark_runs))
query("lat_raw_recent", """SELECT target, concurrency, query_name, b.run_id, iteration, latency_ms FROM benchmark_raw b
  JOIN benchmark_runs r ON r.run_id = b.run_id WHERE COALESCE(mode, 'lockstep') = 'lockstep' AND started_on >= DATE '2024-01-30' - 7
  ORDER BY started_on DESC, iteration LIMIT 50000""")(
    lambda x: latency.raw_recent(x.t.benchmark_raw, x.t.benchmark_runs, "2024-01-30"))
query("lat_q8_headline", """SELECT query_name, target, p50_ms, p95_ms, p99_ms, mean_ms, successful, failed, target_rate_qps, run_id FROM (
  SELECT s.*, target_rate_qps, row_number() OVER (PARTITION BY query_name, target ORDER BY started_on DESC, concurrency) AS rn
  FROM bsummary s JOIN benchmark_runs r ON r.run_id = s.run_id WHERE mode = 'sustained' AND query_name IN ('click','view')) q WHERE rn = 1""")(
    lambda x: latency.latest_headline(summary(x), x.t.benchmark_runs, NAMES))
query("lat_q8_samples", """SELECT b.query_name, target_rate_qps, iteration, latency_ms, queue_time_ms, total_latency_ms, scheduled_arrival_offset_ms, actual_start_offset_ms
  FROM benchmark_raw b JOIN (SELECT run_id, target_rate_qps, query_name FROM (
    SELECT s.run_id, target_rate_qps, query_name, row_number() OVER (PARTITION BY query_name, target_rate_qps ORDER BY started_on DESC) AS rk
    FROM (SELECT DISTINCT run_id, query_name FROM bsummary WHERE query_name IN ('click','view')) s
    JOIN benchmark_runs r ON r.run_id = s.run_id WHERE mode = 'sustained') q WHERE rk = 1) k
  ON k.run_id = b.run_id AND k.query_name = b.query_name WHERE success AND NOT is_warmup""")(
    lambda x: latency.latest_samples(summary(x), x.t.benchmark_runs, x.t.benchmark_raw, NAMES))
query("lat_sustained_worst_case", f"""SELECT p50_ms, p95_ms, p99_ms, mean_ms FROM bsummary s JOIN benchmark_runs r ON r.run_id = s.run_id
  WHERE mode = 'sustained' AND query_name = '{WORST}' AND target = 'warehouse' ORDER BY started_on DESC, concurrency LIMIT 1""")(
    lambda x: latency.worst_case_latest(summary(x), x.t.benchmark_runs, WORST, "warehouse"))
query("lat_warmup", """SELECT target, query_name, iteration, actual_start_offset_ms, queue_time_ms, latency_ms, total_latency_ms, success
  FROM benchmark_raw WHERE is_warmup AND run_id = (SELECT run_id FROM benchmark_runs WHERE mode = 'sustained' ORDER BY started_on DESC LIMIT 1)""")(
    lambda x: latency.warmup_samples(x.t.benchmark_raw, x.t.benchmark_runs))
query("lat_mix_mean", f"SELECT target, concurrency, {mavg('p95_ms', '1000000e0')} AS p95_ms FROM bsummary WHERE query_name <> '{WORST}' GROUP BY 1, 2")(
    lambda x: latency.mix_mean(summary(x), WORST))
query("lat_mix_throughput", f"""SELECT target, concurrency, CAST(SUM({c("throughput_qps", "1000000e0")}) AS DOUBLE) / 1000000e0 AS throughput_qps
  FROM bsummary WHERE query_name <> '{WORST}' GROUP BY 1, 2""")(lambda x: latency.mix_throughput(summary(x), WORST))
query("lat_top_concurrency", "SELECT run_id, target, concurrency, query_name, p95_ms FROM bsummary WHERE concurrency = (SELECT MAX(concurrency) FROM bsummary)")(
    lambda x: latency.top_concurrency(summary(x)).select("run_id", "target", "concurrency", "query_name", "p95_ms"))
query("lat_cdf", """SELECT target, total_latency_ms, CAST(row_number() OVER (PARTITION BY target ORDER BY total_latency_ms) AS DOUBLE)
  / CAST(COUNT(*) OVER (PARTITION BY target) AS DOUBLE) * 100e0 AS cdf FROM benchmark_raw WHERE success AND NOT is_warmup""")(
    lambda x: latency.cdf(x.t.benchmark_raw))
query("lat_timeline", f"""SELECT run_id, query_name, iteration, latency_ms,
  (scheduled_arrival_offset_ms - MIN(scheduled_arrival_offset_ms) OVER (PARTITION BY run_id, query_name)) / 1000e0 AS elapsed_s,
  {rnd("quantile_cont(latency_ms, 0.95) OVER (PARTITION BY run_id, query_name)", 6)} AS series_p95_ms FROM benchmark_raw""")(
    lambda x: latency.timeline(x.t.benchmark_raw.select("run_id", "query_name", "iteration", "latency_ms", "scheduled_arrival_offset_ms"),
                               ["run_id", "query_name"]).drop("scheduled_arrival_offset_ms"))
query("lat_slo_check", """SELECT run_id, target, concurrency, query_name, p50_ms <= 50 AS p50_ms_met, p95_ms <= 120 AS p95_ms_met, p99_ms <= 200 AS p99_ms_met,
  p50_ms <= 50 AND p95_ms <= 120 AND p99_ms <= 200 AS slo_met FROM bsummary""")(
    lambda x: latency.slo_check(summary(x), {"p50_ms": 50.0, "p95_ms": 120.0, "p99_ms": 200.0}).select(
        "run_id", "target", "concurrency", "query_name", "p50_ms_met", "p95_ms_met", "p99_ms_met", "slo_met"))
query("lat_speedup", """SELECT *, CASE WHEN base_p95_ms < 7200000 THEN base_p95_ms / NULLIF(other_p95_ms, 0) END AS speedup,
  CASE WHEN base_p95_ms IS NULL OR other_p95_ms IS NULL THEN 'pending' WHEN base_p95_ms < 7200000 THEN 'ok' ELSE 'DNF' END AS outcome FROM (
  SELECT target, MAX(p95_ms) FILTER (query_name = 'click') AS base_p95_ms, MAX(p95_ms) FILTER (query_name = 'view') AS other_p95_ms FROM bsummary GROUP BY 1) w""")(
    lambda x: latency.speedup(summary(x), "click", "view"))
query("lat_percentile_unpivot", """SELECT query_name, target, percentile, value_ms FROM (SELECT query_name, target, p50_ms, p95_ms, p99_ms FROM bsummary)
  UNPIVOT (value_ms FOR percentile IN (p50_ms, p95_ms, p99_ms))""")(lambda x: latency.percentile_rows(summary(x)))
query("lat_qps_gap", """SELECT b.run_id, target, bucket_start_offset_s, is_warmup, achieved_qps, target_rate_qps, target_rate_qps - achieved_qps AS qps_gap,
  achieved_qps >= target_rate_qps AS kept_pace FROM bbuckets b JOIN benchmark_runs r ON r.run_id = b.run_id""")(
    lambda x: latency.qps_gap(buckets(x), x.t.benchmark_runs))
query("lat_run_derive", """SELECT run_id || 'T00:00:00Z' AS run_id, array_to_string(list_sort(list(DISTINCT target)), '|') AS targets,
  strftime(CAST(run_id AS TIMESTAMP) + to_seconds(CAST(floor(MAX(actual_start_offset_ms) / 1000e0) AS BIGINT) + 30), '%Y-%m-%d %H:%M:%S') AS ended_at
  FROM benchmark_raw GROUP BY benchmark_raw.run_id""")(
    lambda x: latency.derive_runs(x.t.benchmark_raw.withColumn("run_dir", F.concat(F.regexp_replace("run_id", "-", ""), F.lit("_000000")))).select(
        "run_id", F.array_join("targets", "|").alias("targets"), F.date_format("ended_at", "yyyy-MM-dd HH:mm:ss").alias("ended_at")))
query("lat_median_compare", """SELECT *, base_ms / NULLIF(other_ms, 0) AS speedup FROM (
  SELECT query_name, MAX(m) FILTER (target = 'warehouse') AS base_ms, MAX(m) FILTER (target = 'postgres') AS other_ms FROM (
    SELECT query_name, target, list_sort(list(latency_ms))[COUNT(*) // 2 + 1] AS m FROM benchmark_raw GROUP BY 1, 2) s GROUP BY 1) w""")(
    lambda x: latency.median_compare(x.t.benchmark_raw, "warehouse", "postgres"))

# ------------------------------------------------------------ audit
NOW = "2024-01-30 12:00:00"


def log(x):
    return audit.nested_log(x.t.audit_flat)


query("aud_recent_activity", f"""SELECT event_id, event_time, user_email, service_name, action_name, source_ip_address, request_params, status_code
  FROM audit_flat WHERE event_time >= TIMESTAMP '{NOW}' - INTERVAL 72 HOUR AND (request_params LIKE '%9%' OR CAST(status_code AS STRING) LIKE '%9%')
  ORDER BY event_time DESC, event_id LIMIT 200""")(lambda x: audit.recent_activity(log(x), "9", 72, NOW))
query("aud_grant_changes", f"""SELECT event_id, event_time, user_email, action_name, request_params, status_code FROM audit_flat
  WHERE event_time >= TIMESTAMP '{NOW}' - INTERVAL 90 DAY AND service_name = 'catalog'
  AND action_name IN ('updatePermissions','grantPermission','revokePermission') AND request_params LIKE '%7%'""")(
    lambda x: audit.grant_changes(log(x), "7", 90, NOW, "catalog", k=None))
query("aud_tenant_access", f"""SELECT event_id, event_time, user_email, service_name, action_name, source_ip_address, status_code FROM audit_flat
  WHERE event_time >= TIMESTAMP '{NOW}' - INTERVAL 90 DAY AND request_params LIKE '%"k": 42%'""")(
    lambda x: audit.tenant_access(log(x), '"k": 42', NOW))
query("aud_schema_changes", f"""SELECT event_id, event_time, user_email, action_name, request_params FROM audit_flat
  WHERE event_time >= TIMESTAMP '{NOW}' - INTERVAL 90 DAY AND service_name = 'catalog'
  AND action_name IN ('createTable','alterTable','dropTable','updateTable') AND request_params LIKE '%3%'""")(
    lambda x: audit.schema_changes(log(x), "3", NOW, "catalog"))
query("aud_failed_logins", f"""SELECT event_id, event_time, user_email, service_name, action_name, source_ip_address, status_code FROM audit_flat
  WHERE event_time >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND status_code BETWEEN 400 AND 499 AND action_name IN ('tokenLogin','login','samlLogin')""")(
    lambda x: audit.failed_logins(log(x), NOW))
query("aud_kpis", "SELECT COUNT(*) AS events, COUNT(DISTINCT user_email) AS users, COUNT(DISTINCT service_name) AS services FROM audit_flat")(
    lambda x: audit.kpis(log(x)))
query("use_cost_by_tag", f"""SELECT tier, CAST(SUM({c("usage_quantity")} * unit_cents) AS DOUBLE) / 10000e0 AS usd_spend, COUNT(*) AS records
  FROM usage_records u LEFT JOIN price_list p ON p.sku_name = u.sku_name
  WHERE usage_date >= DATE '2024-01-30' - 30 AND project = 'project1' GROUP BY tier""")(
    lambda x: audit.cost_by_tag(x.t.usage_records, x.t.price_list, "project1", "2024-01-30"))
query("cat_grants_union", """SELECT * FROM (SELECT 'CATALOG' AS object_type, catalog_name AS object_key, grantor, grantee, privilege_type
    FROM catalog_privileges WHERE catalog_name = 'NATION_9'
  UNION ALL SELECT 'SCHEMA', catalog_name || '.' || schema_name, grantor, grantee, privilege_type FROM schema_privileges
    WHERE catalog_name = 'NATION_9' AND schema_name = 'schema_1'
  UNION ALL SELECT 'TABLE', table_catalog || '.' || table_schema || '.' || table_name, grantor, grantee, privilege_type FROM table_privileges
    WHERE table_catalog = 'NATION_9' AND table_schema = 'schema_1' AND table_name IN ('building','machinery','household')) u
  ORDER BY object_type, object_key, grantee, privilege_type LIMIT 200""")(
    lambda x: audit.grants_union(x.t.catalog_privileges, x.t.schema_privileges, x.t.table_privileges, "NATION_9", "schema_1",
                                 ["building", "machinery", "household"]))
query("cat_table_metadata", """SELECT * FROM info_tables WHERE substr(table_name, 1, 2) <> '__' AND substr(table_name, 1, 10) <> 'event_log_'
  AND table_type <> 'FOREIGN'""")(lambda x: audit.table_metadata(x.t.info_tables))
query("cat_tags_union", """SELECT * FROM (SELECT 'TABLE' AS level, table_name, NULL AS column_name, tag_name, tag_value FROM table_tags
  UNION ALL SELECT 'COLUMN', table_name, column_name, tag_name, tag_value FROM column_tags) u
  ORDER BY level, table_name, column_name NULLS FIRST, tag_name, tag_value LIMIT 200""")(lambda x: audit.tags_union(x.t.table_tags, x.t.column_tags))
query("cat_pipelines_recent", """SELECT pipeline_id, name, change_time FROM pipelines WHERE delete_time IS NULL
  AND (lower(name) LIKE '%ledger%' OR name ILIKE 'Synced table: ledger%') ORDER BY change_time DESC, pipeline_id LIMIT 50""")(
    lambda x: audit.pipelines_recent(x.t.pipelines, ["%ledger%", "Synced table: ledger%"]))

# ------------------------------------------------------------ references of the ledger tables
LINKS = [("funds", ["arena_id"], "arenas"), ("investors", ["fund_id"], "active_funds"), ("properties", ["fund_id"], "funds"),
         ("gl", ["arena_id"], "arenas"), ("gl", ["fund_id"], "active_funds"), ("gl", ["property_id", "fund_id"], "properties"), ("dirty", ["arena_id"], "arenas")]
SOURCES = {"arenas": "arenas", "funds": "funds", "active_funds": "(SELECT * FROM funds WHERE status = 'active') f", "investors": "investors",
           "properties": "properties", "gl": "gl_raw", "dirty": "gl_dirty"}
query("gen_integrity_check", " UNION ALL ".join(
    [f"SELECT 'rows_{n}' AS check_name, COUNT(*) AS value FROM {t}" for n, t in SOURCES.items()]
    + [f"""SELECT 'orphans_{a}_{"_".join(k)}', COUNT(*) FROM (SELECT * FROM {SOURCES[a]}) x WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM {SOURCES[b]}) y
       WHERE {" AND ".join(f"x.{c} = y.{c}" for c in k)})""" for a, k, b in LINKS]))(
    lambda x: integrity.integrity_report({
        "arenas": x.t.arenas, "funds": x.t.funds, "active_funds": x.t.funds.where("status = 'active'"), "investors": x.t.investors,
        "properties": x.t.properties, "gl": x.t.gl_raw, "dirty": x.t.gl_dirty}, LINKS))
