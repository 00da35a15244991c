"""Gold rollups.  The fact side is always aggregated before a dimension joins,
so dimensions meet one row per group rather than every ledger row.

The three ledger rollups accept the ledger itself or its monthly base.  An update
that builds all of them scans the ledger once, for the base.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreledger.functions.money import cents, from_cents, money_sum
from acreledger.functions.scalars import joined_set, month_start

# Primary keys of the published tables.
PRIMARY_KEYS = {
    "gold_fund_performance": ["fund_id"],
    "gold_property_financials": ["arena_id", "property_id", "month"],
    "gold_investor_portfolio": ["arena_id", "investor_id"],
    "gold_gl_monthly_summary": ["arena_id", "fund_id", "month", "category"],
    "gold_arena_overview": ["arena_id"],
}


# Grain of the monthly base and its additive measures.
BASE_KEYS = ["arena_id", "property_id", "fund_id", "category", "is_expense", "month", "in_ttm"]
MEASURES = ["amount_cents", "amount_count", "transaction_count"]


def ledger_rows(gl: DataFrame, as_of: str | None = None) -> DataFrame:
    """Ledger rows as additive measures; a monthly base passes through unchanged."""
    if "amount_cents" in gl.columns:
        return gl
    day = F.col("transaction_date")
    ttm = F.lit(False) if as_of is None else day >= F.add_months(F.lit(as_of).cast("date"), -12)
    return gl.select(
        "arena_id", "property_id", "fund_id", "category", "is_expense", month_start(day).alias("month"), ttm.alias("in_ttm"),
        cents("amount").alias("amount_cents"), F.col("amount").isNotNull().cast("long").alias("amount_count"),
        F.col("transaction_id").isNotNull().cast("long").alias("transaction_count"))


def ledger_base(gl: DataFrame, as_of: str) -> DataFrame:
    """One row per tenant, property, fund, category and month (split at the trailing-year cut)."""
    return ledger_rows(gl, as_of).groupBy(*BASE_KEYS).agg(*[F.sum(c).alias(c) for c in MEASURES])


def _cents_where(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("amount_cents")).otherwise(F.lit(0)))


def fund_performance(funds: DataFrame, properties: DataFrame, investors: DataFrame) -> DataFrame:
    held = properties.groupBy("fund_id").agg(
        F.count("property_id").alias("property_count"),
        money_sum("acquisition_price").alias("total_invested"),
        money_sum("current_valuation").alias("current_portfolio_value"),
        money_sum("unrealized_gain").alias("unrealized_gain_loss"),
    )
    backed = investors.groupBy("fund_id").agg(
        F.count("investor_id").alias("investor_count"),
        money_sum("commitment_amount").alias("total_commitments"),
    )
    return funds.join(held, "fund_id", "left").join(backed, "fund_id", "left").select(
        "arena_id", "fund_id", "fund_name", "strategy", F.col("aum").alias("total_aum"), "property_count",
        "total_invested", "current_portfolio_value", "unrealized_gain_loss", "investor_count", "total_commitments",
    )


def property_financials(properties: DataFrame, funds: DataFrame, gl: DataFrame, expense_sign: int = 1) -> DataFrame:
    """Monthly P&L per property.

    noi = revenue - expenses over the signed ledger, where expense amounts are
    negative; ``expense_sign=-1`` gives revenue plus signed expenses instead.
    """
    revenue, expenses = _cents_where(F.col("category") == "revenue"), _cents_where(F.col("is_expense"))
    monthly = ledger_rows(gl).groupBy("arena_id", "property_id", "month").agg(
        from_cents(revenue).alias("revenue"), from_cents(expenses).alias("expenses"),
        from_cents(revenue - F.lit(expense_sign) * expenses).alias("noi"))
    return (
        monthly.join(properties.drop("arena_id"), "property_id", "left")
        .join(funds.select("fund_id", "fund_name"), "fund_id", "left")
        .select("arena_id", "property_id", "property_name", "property_type", "fund_id", "fund_name", "month",
                "revenue", "expenses", "noi", "occupancy_rate")
    )


def investor_portfolio(investors: DataFrame, funds: DataFrame) -> DataFrame:
    keys = ["arena_id", "investor_id", "investor_name", "type", "city", "state"]
    return (
        investors.join(funds.drop("arena_id"), "fund_id", "left")
        .groupBy(*keys)
        .agg(
            F.count("fund_id").alias("fund_commitment_count"),
            money_sum("commitment_amount").alias("total_committed"),
            joined_set(F.collect_set("fund_name")).alias("fund_names"),
        )
    )


def gl_monthly_summary(gl: DataFrame, funds: DataFrame) -> DataFrame:
    total, n = F.sum("amount_cents"), F.sum("amount_count")
    monthly = ledger_rows(gl).groupBy("arena_id", "fund_id", "category", "month").agg(
        from_cents(total).alias("total_amount"), F.sum("transaction_count").alias("transaction_count"),
        (total.cast("double") / n.cast("double") / F.lit(100.0)).alias("avg_transaction_amount"))
    return monthly.join(funds.select("fund_id", "fund_name"), "fund_id", "left").select(
        "arena_id", "fund_id", "fund_name", "category", "month", "total_amount", "transaction_count",
        "avg_transaction_amount",
    )


def arena_overview(
    arenas: DataFrame, funds: DataFrame, properties: DataFrame, investors: DataFrame, gl: DataFrame, as_of: str
) -> DataFrame:
    """Tenant KPIs with revenue and NOI of the twelve months before ``as_of``.

    A monthly base must have been made with the same ``as_of``.
    """
    aum = funds.groupBy("arena_id").agg(money_sum("aum").alias("total_aum"))
    held = properties.groupBy("arena_id").agg(F.countDistinct("property_id").alias("total_properties"))
    backed = investors.groupBy("arena_id").agg(
        F.countDistinct("investor_id").alias("total_investors"),
        money_sum("commitment_amount").alias("total_commitments"),
    )
    revenue, expenses = _cents_where(F.col("category") == "revenue"), _cents_where(F.col("is_expense"))
    ttm = ledger_rows(gl, as_of).where("in_ttm").groupBy("arena_id").agg(
        from_cents(revenue).alias("total_revenue"), from_cents(revenue - expenses).alias("total_noi"))
    out = arenas.select("arena_id", "arena_name")
    for part in (aum, held, backed, ttm):
        out = out.join(part, "arena_id", "left")
    return out.select("arena_id", "arena_name", "total_aum", "total_properties", "total_investors",
                      "total_commitments", "total_revenue", "total_noi")
