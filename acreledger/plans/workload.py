"""The per-tenant query workload Q1-Q7 and the lookups served from gold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreledger.functions.money import cents, from_cents, money_avg, money_sum, round_half_up, safe_ratio
from acreledger.functions.scalars import month_date
from acreledger.operators.aggregates import sum_where
from acreledger.operators.ordering import lag_within, top_per_group
from acreledger.operators.predicates import tenant_eq, trailing_months


def fund_performance_arena(gold_fund: DataFrame, arena_id: str) -> DataFrame:
    return tenant_eq(gold_fund, "arena_id", arena_id).orderBy(F.desc("total_aum"), "fund_id")


def gl_monthly_by_arena_year(gold_gl: DataFrame, arena_id: str, as_of: str) -> DataFrame:
    """Category by month over 12 months.  The average is the unweighted mean of
    stored averages; the weighted one is given next to it."""
    rows = trailing_months(tenant_eq(gold_gl, "arena_id", arena_id), "month", 12, as_of)
    return (
        rows.groupBy("category", month_date(F.col("month")).alias("month"))
        .agg(
            money_sum("total_amount").alias("total_amount"),
            F.sum("transaction_count").alias("transaction_count"),
            round_half_up(money_avg("avg_transaction_amount", 1_000_000), 2).alias("avg_transaction_amount"),
            round_half_up(
                F.sum(cents("total_amount")).cast("double") / F.sum("transaction_count").cast("double") / F.lit(100.0), 2
            ).alias("weighted_avg_amount"),
        )
        .orderBy("month", "category")
    )


def property_financials_joined(
    gold_property: DataFrame, arenas: DataFrame, funds: DataFrame, arena_id: str, as_of: str
) -> DataFrame:
    rows = trailing_months(tenant_eq(gold_property, "arena_id", arena_id), "month", 6, as_of)
    return (
        rows.drop("fund_name")
        .join(tenant_eq(arenas, "arena_id", arena_id).select("arena_id", "arena_name", "tier"), "arena_id")
        .join(funds.select("fund_id", "arena_id", "fund_name", "strategy"), ["fund_id", "arena_id"])
        .orderBy(F.desc("month"), F.desc("noi"), "property_id")
        .limit(100)
        .select("property_id", "property_name", "property_type", "arena_name", "tier", "fund_name", "strategy",
                month_date(F.col("month")).alias("month"), "revenue", "expenses", "noi", "occupancy_rate")
    )


def top_properties_by_revenue(gold_property: DataFrame, arena_id: str, as_of: str, k: int = 10) -> DataFrame:
    rows = trailing_months(tenant_eq(gold_property, "arena_id", arena_id), "month", 12, as_of)
    ttm = rows.groupBy("arena_id", "property_id", "property_name", "property_type", "fund_name").agg(
        money_sum("revenue").alias("revenue_ttm"),
        money_sum("noi").alias("noi_ttm"),
        money_avg("occupancy_rate").alias("avg_occupancy"),
    )
    ranked = top_per_group(ttm, ["arena_id"], [F.desc("revenue_ttm")], k, "revenue_rank")
    return ranked.drop("arena_id").orderBy("revenue_rank", "property_id").limit(k)


def pnl_rollup(gold_gl: DataFrame, funds: DataFrame, arena_id: str, as_of: str) -> DataFrame:
    """P&L per fund and month over 24 months; every non-revenue category is expense."""
    rows = trailing_months(tenant_eq(gold_gl, "arena_id", arena_id), "month", 24, as_of)
    keys = ["fund_id", "fund_name", "strategy", "vintage_year"]
    return (
        rows.drop("fund_name").join(funds.select("arena_id", *keys), ["fund_id", "arena_id"])
        .groupBy(*keys, month_date(F.col("month")).alias("month"))
        .agg(
            sum_where("total_amount", F.col("category") == "revenue").alias("revenue"),
            sum_where("total_amount", F.col("category") != "revenue").alias("expenses"),
            F.sum("transaction_count").alias("transaction_count"),
            round_half_up(money_avg("avg_transaction_amount", 1_000_000), 2).alias("avg_txn_amount"),
        )
        .withColumn("net_income", from_cents(cents("revenue") - cents("expenses")))
        .orderBy("fund_name", "month")
    )


def investor_commitments(investors: DataFrame, funds: DataFrame, arena_id: str) -> DataFrame:
    keys = ["investor_id", "investor_name", "type", "city", "state"]
    return (
        tenant_eq(investors, "arena_id", arena_id)
        .join(funds.select("fund_id", "arena_id", "fund_name"), ["fund_id", "arena_id"])
        .groupBy(*keys)
        .agg(
            money_sum("commitment_amount").alias("total_commitment"),
            F.countDistinct("fund_id").alias("fund_count"),
            F.array_sort(F.collect_set("fund_name")).alias("funds"),
        )
        .orderBy(F.desc("total_commitment"), "investor_id")
    )


def yoy_growth(gl: DataFrame, properties: DataFrame, funds: DataFrame, year_to: int, k: int = 100, rows: int = 300) -> DataFrame:
    """Cross-tenant top properties by yearly revenue growth over four fiscal years."""
    approved = gl.where(
        F.col("fiscal_year").between(year_to - 3, year_to)
        & (F.col("approval_status") == "approved")
        & (F.col("currency") == "USD")
    )
    # the joins only ask that property and fund exist, so they run after the rollup
    annual = (
        approved.groupBy("property_id", "fund_id", "fiscal_year", "counterparty_id")
        .agg(F.sum(cents(F.when(F.col("category") == "revenue", F.col("amount")).otherwise(F.lit(0.0)))).alias("__rev"))
        .join(properties.select("property_id"), "property_id", "left_semi")
        .join(funds.select("fund_id"), "fund_id", "left_semi")
        .groupBy("property_id", "fiscal_year")
        .agg(from_cents(F.sum("__rev")).alias("rev"), F.countDistinct("counterparty_id").alias("counterparty_count"))
    )
    growth = lag_within(annual, ["property_id"], ["fiscal_year"], "rev", "prev_rev").withColumn(
        "yoy_growth", safe_ratio(F.col("rev") - F.col("prev_rev"), F.col("prev_rev"))
    )
    ranked = top_per_group(growth.where("yoy_growth IS NOT NULL"), ["fiscal_year"], [F.desc("yoy_growth")], k)
    return ranked.orderBy(F.desc("fiscal_year"), "rnk", "property_id").limit(rows)


# ------------------------------------------------------------ serving lookups
def gl_by_fund(gold_gl: DataFrame, fund_name: str) -> DataFrame:
    return gold_gl.where(F.col("fund_name") == fund_name).orderBy("month", "category").select(
        "fund_name", "category", month_date(F.col("month")).alias("month"), "total_amount")


def top_funds(gold_fund: DataFrame, n: int = 20) -> DataFrame:
    return gold_fund.orderBy(F.desc("total_aum"), "fund_id").limit(n)


def property_noi_trend(gold_property: DataFrame, fund_name: str) -> DataFrame:
    return gold_property.where(F.col("fund_name") == fund_name).orderBy("month", "property_id").select(
        "property_id", "property_name", month_date(F.col("month")).alias("month"), "noi")
