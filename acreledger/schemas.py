"""Declared schemas of the landing files and result tables."""

from __future__ import annotations

from pyspark.sql import types as T


TYPES = {
    "STRING": T.StringType(), "DOUBLE": T.DoubleType(), "INT": T.IntegerType(), "BOOLEAN": T.BooleanType(), "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampType(), "ARRAY<STRING>": T.ArrayType(T.StringType()), "ARRAY<INT>": T.ArrayType(T.IntegerType()),
}


def _struct(spec: str) -> T.StructType:
    """'name TYPE, name TYPE' as a schema; needs no running session."""
    pairs = [field.split(" ") for field in spec.split(", ")]
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in pairs])


ARENAS = _struct("arena_id STRING, arena_name STRING, tier STRING, created_at TIMESTAMP")
FUNDS = _struct(
    "fund_id STRING, arena_id STRING, fund_name STRING, vintage_year INT, strategy STRING, target_return_pct DOUBLE, aum DOUBLE, status STRING")
INVESTORS = _struct(
    "investor_id STRING, arena_id STRING, investor_name STRING, type STRING, commitment_amount DOUBLE, fund_id STRING, city STRING, state STRING")
PROPERTIES = _struct(
    "property_id STRING, arena_id STRING, fund_id STRING, property_name STRING, address STRING, city STRING, state STRING, property_type STRING, "
    "acquisition_date DATE, acquisition_price DOUBLE, current_valuation DOUBLE, square_footage INT, occupancy_rate DOUBLE")
GL_TRANSACTIONS = _struct(
    "transaction_id STRING, arena_id STRING, property_id STRING, fund_id STRING, account_code STRING, account_name STRING, description STRING, "
    "amount DOUBLE, transaction_date DATE, category STRING, posted BOOLEAN, year INT, month INT")
GL_WIDE_EXTRAS = _struct(
    "memo_text STRING, reference_id STRING, external_ref_id STRING, currency STRING, fx_rate_to_usd DOUBLE, approval_status STRING, approver_id STRING, "
    "approval_date DATE, cost_center STRING, department_code STRING, counterparty_name STRING, counterparty_id STRING")

BENCHMARK_RUNS = _struct(
    "run_id STRING, started_at TIMESTAMP, ended_at TIMESTAMP, git_sha STRING, workspace STRING, targets ARRAY<STRING>, concurrency_levels ARRAY<INT>, "
    "iterations INT, warmup INT, notes STRING, mode STRING, target_rate_qps DOUBLE, arrival_distribution STRING, duration_seconds INT, warmup_seconds INT")
BENCHMARK_SUMMARY = _struct(
    "run_id STRING, target STRING, concurrency INT, query_name STRING, total_queries INT, successful INT, failed INT, p50_ms DOUBLE, p95_ms DOUBLE, "
    "p99_ms DOUBLE, min_ms DOUBLE, max_ms DOUBLE, mean_ms DOUBLE, throughput_qps DOUBLE, error_rate DOUBLE")
BENCHMARK_RAW = _struct(
    "run_id STRING, target STRING, concurrency INT, query_name STRING, iteration INT, thread_id INT, latency_ms DOUBLE, success BOOLEAN, error STRING, "
    "scheduled_arrival_offset_ms DOUBLE, actual_start_offset_ms DOUBLE, queue_time_ms DOUBLE, total_latency_ms DOUBLE, is_warmup BOOLEAN")
BENCHMARK_TIMESERIES = _struct(
    "run_id STRING, target STRING, query_name STRING, bucket_start_offset_s INT, bucket_end_offset_s INT, p50_ms DOUBLE, p95_ms DOUBLE, max_ms DOUBLE, "
    "achieved_qps DOUBLE, error_count INT, is_warmup BOOLEAN")


def widen(old: T.StructType, new: T.StructType) -> T.StructType:
    """Known columns first, then columns seen for the first time (all nullable)."""
    known = {f.name for f in old.fields}
    return T.StructType([*old.fields, *[T.StructField(f.name, f.dataType, True) for f in new.fields if f.name not in known]])
