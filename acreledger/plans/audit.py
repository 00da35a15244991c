"""Audit-log, usage and catalog reports over event and metadata tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreledger.functions.money import cents
from acreledger.functions.scalars import concat_key
from acreledger.operators.ordering import case_order, union_padded, union_tagged
from acreledger.operators.predicates import contains_any, exclude_prefixes, ilike_any, lookback

# Action names of the access log.
GRANT_ACTIONS = ["updatePermissions", "grantPermission", "revokePermission"]
SCHEMA_ACTIONS = ["createTable", "alterTable", "dropTable", "updateTable"]
LOGIN_ACTIONS = ["tokenLogin", "login", "samlLogin"]
TABLE_TYPE_ORDER = ["MATERIALIZED_VIEW", "STREAMING_TABLE", "MANAGED"]


def nested_log(flat: DataFrame) -> DataFrame:
    """The log in its nested shape: user_identity and response are structs."""
    return flat.select(
        "event_id", "event_time", F.struct(F.col("user_email").alias("email")).alias("user_identity"), "service_name",
        "action_name", "source_ip_address", "request_params", F.struct("status_code").alias("response"))


def _report(rows: DataFrame, *extra: str) -> DataFrame:
    cols = {
        "user_email": F.col("user_identity.email").alias("user_email"),
        "status_code": F.col("response.status_code").alias("status_code"),
    }
    return rows.select("event_id", "event_time", *[cols.get(c, F.col(c)) for c in extra])


def recent_activity(log: DataFrame, needle: str, hours: int, as_of: str, k: int = 200) -> DataFrame:
    rows = contains_any(lookback(log, "event_time", f"{hours} HOURS", as_of), ["request_params", "response"], needle)
    return _report(rows.orderBy(F.desc("event_time"), "event_id").limit(k),
                   "user_email", "service_name", "action_name", "source_ip_address", "request_params", "status_code")


def grant_changes(log: DataFrame, needle: str, days: int, as_of: str, service: str, k: int | None = 50) -> DataFrame:
    """Permission changes; ``k=None`` gives the whole quarter instead of the newest rows."""
    rows = lookback(log, "event_time", f"{days} DAYS", as_of).where(
        (F.col("service_name") == service) & F.col("action_name").isin(GRANT_ACTIONS))
    rows = contains_any(rows, ["request_params"], needle).orderBy(F.desc("event_time"), "event_id")
    return _report(rows if k is None else rows.limit(k), "user_email", "action_name", "request_params", "status_code")


def tenant_access(log: DataFrame, needle: str, as_of: str, days: int = 90) -> DataFrame:
    rows = contains_any(lookback(log, "event_time", f"{days} DAYS", as_of), ["request_params"], needle)
    return _report(rows, "user_email", "service_name", "action_name", "source_ip_address", "status_code")


def schema_changes(log: DataFrame, needle: str, as_of: str, service: str, days: int = 90) -> DataFrame:
    rows = lookback(log, "event_time", f"{days} DAYS", as_of).where(
        (F.col("service_name") == service) & F.col("action_name").isin(SCHEMA_ACTIONS))
    return _report(contains_any(rows, ["request_params"], needle), "user_email", "action_name", "request_params")


def failed_logins(log: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    rows = lookback(log, "event_time", f"{days} DAYS", as_of).where(
        F.col("response.status_code").between(400, 499) & F.col("action_name").isin(LOGIN_ACTIONS))
    return _report(rows, "user_email", "service_name", "action_name", "source_ip_address", "status_code")


def kpis(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count(F.lit(1)).alias("events"),
        F.countDistinct("user_identity.email").alias("users"),
        F.countDistinct("service_name").alias("services"),
    )


def priced_usage(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage with its list price; unpriced usage keeps a NULL amount."""
    joined = usage.join(prices, "sku_name", "left")
    return joined.withColumn("usd", (cents("usage_quantity") * F.col("unit_cents")).cast("double") / F.lit(10_000.0))


def cost_by_tag(usage: DataFrame, prices: DataFrame, project: str, as_of: str, days: int = 30, tag: str = "tier") -> DataFrame:
    """Spend per tag over the last days.  Quantities are summed per SKU before prices join."""
    recent = usage.where((F.col("usage_date") >= F.date_sub(F.lit(as_of).cast("date"), days)) & (F.col("project") == project))
    per_sku = recent.groupBy(tag, "sku_name").agg(F.sum(cents("usage_quantity")).alias("__q"), F.count(F.lit(1)).alias("__n"))
    return (
        per_sku.join(prices, "sku_name", "left").groupBy(tag)
        .agg((F.sum(F.col("__q") * F.col("unit_cents")).cast("double") / F.lit(10_000.0)).alias("usd_spend"), F.sum("__n").alias("records"))
        .orderBy(F.desc("usd_spend"))
    )


def grants_union(catalogs: DataFrame, schemas: DataFrame, tables: DataFrame, catalog: str, schema: str,
                 table_names: Sequence[str], k: int = 200) -> DataFrame:
    """Privileges at catalog, schema and table level in one listing."""
    cols = ["grantor", "grantee", "privilege_type"]
    levels = {
        "CATALOG": catalogs.where(F.col("catalog_name") == catalog).select(F.col("catalog_name").alias("object_key"), *cols),
        "SCHEMA": schemas.where((F.col("catalog_name") == catalog) & (F.col("schema_name") == schema)).select(
            concat_key("catalog_name", "schema_name").alias("object_key"), *cols),
        "TABLE": tables.where((F.col("table_catalog") == catalog) & (F.col("table_schema") == schema)
                              & F.col("table_name").isin(list(table_names))).select(
            concat_key("table_catalog", "table_schema", "table_name").alias("object_key"), *cols),
    }
    return union_tagged(levels, "object_type").orderBy("object_type", "object_key", "grantee", "privilege_type").limit(k)


def table_metadata(tables: DataFrame) -> DataFrame:
    rows = exclude_prefixes(tables, "table_name", ["__", "event_log_"]).where(F.col("table_type") != "FOREIGN")
    return rows.orderBy(case_order("table_type", TABLE_TYPE_ORDER), "table_name")


def tags_union(table_tags: DataFrame, column_tags: DataFrame, k: int = 200) -> DataFrame:
    rows = union_padded(column_tags.withColumn("level", F.lit("COLUMN")), table_tags.withColumn("level", F.lit("TABLE")))
    return rows.orderBy("level", "table_name", F.asc_nulls_first("column_name"), "tag_name", "tag_value").limit(k)


def pipelines_recent(pipelines: DataFrame, patterns: Sequence[str], k: int = 50) -> DataFrame:
    live = ilike_any(pipelines.where(F.col("delete_time").isNull()), "name", patterns)
    return live.orderBy(F.desc("change_time"), "pipeline_id").limit(k).select("pipeline_id", "name", "change_time")
