"""Investor capital-account statements.

Every fact is summed to (investor, fund) or finer before it meets another one;
joining raw facts to each other would multiply their totals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acreledger.functions.money import cents, from_cents, money_avg, money_sum, safe_ratio
from acreledger.functions.scalars import period_label
from acreledger.operators.aggregates import sum_where, with_group_value
from acreledger.operators.joins import attach_all, attach_literal, join_parts, role_playing, snowflake
from acreledger.operators.ordering import lag_within
from acreledger.operators.predicates import as_date
from acreledger.plans.fund_metrics import fx_effect, period_rates, property_universe
from acreledger.sources.storage import staged

Star = Mapping[str, DataFrame]
GRAIN = ["investor_id", "fund_id"]
# Fee types, waterfall tiers and K-1 boxes of the statement.
FEE_TYPES = ["MGMT", "PERF", "ADMIN", "AUDIT", "LEGAL", "OTHER"]
TIER_GROUPS = {"roc": ["ROC"], "pref": ["PREF"], "catchup": ["CATCHUP"], "carry": ["CARRY_T1", "CARRY_T2"]}
ALLOCATION_TYPES = {"income": "INCOME", "expense": "EXPENSE", "realized": "REALIZED_GAIN", "unrealized": "UNREALIZED_GAIN"}
K1_BOXES = ["1", "2", "5", "8", "9a", "11"]
CARRY_CODE = "STD_80_20_8PREF"


def within(df: DataFrame, col: str, lo: str, hi: str) -> DataFrame:
    return df.where(F.col(col).between(as_date(lo), as_date(hi)))


def before(df: DataFrame, col: str, day: str) -> DataFrame:
    return df.where(F.col(col) < as_date(day))


# ------------------------------------------------------------ dimensions
def period_setup(s: Star, lo: str, hi: str) -> DataFrame:
    rows = s["dim_period"].where(
        (F.col("period_start") >= as_date(lo)) & (F.col("period_end") <= as_date(hi)) & (F.col("period_type_code") == "QUARTERLY"))
    return attach_literal(rows, s["ref_fiscal_period_type"], "period_type_code", "QUARTERLY", "inner").join(
        s["ref_calendar_quarter"], F.col("fiscal_quarter") == F.col("quarter_num")).select(
        "period_id", "period_label", "period_start", "period_end", "fiscal_year", "fiscal_quarter", "period_type_name", "quarter_label")


def investor_profile(s: Star, investor_id: str | None = None) -> DataFrame:
    rows = s["dim_investor"].where("is_current")
    if investor_id is not None:
        rows = rows.where(F.col("investor_id") == investor_id)
    rows = snowflake(rows, [
        (s["dim_investor_type"], "investor_type_code", "investor_type_code", "inner"),
        (s["dim_investor_subtype"], "investor_subtype_code", "investor_subtype_code", "left"),
        (s["dim_geography_country"], "country_code", "country_code", "inner"),
        (s["dim_tax_jurisdiction"], "tax_jurisdiction_code", "tax_jurisdiction_code", "left"),
    ])
    return rows.withColumnsRenamed({"region": "investor_region", "jurisdiction_name": "tax_jurisdiction_name"}).drop("is_current")


def fund_universe(s: Star) -> DataFrame:
    rows = snowflake(s["dim_fund"].where("is_current"), [
        (s["dim_fund_type"], "fund_type_code", "fund_type_code", "inner"),
        (s["dim_vintage_year"], "vintage_year", "vintage_year", "inner"),
        (s["ref_holding_strategy"], "holding_strategy_code", "strategy_code", "left"),
        (s["ref_investment_strategy"], "invest_strategy_code", "invest_strategy_code", "left"),
        (s["ref_carry_structure"], "carry_code", "carry_code", "left"),
        (s["ref_mgmt_fee_schedule"], "mgmt_fee_code", "schedule_code", "left"),
        (s["dim_currency"], "base_currency", "currency_code", "inner"),
    ])
    return rows.withColumnsRenamed({"strategy_name": "holding_strategy_name", "rate_pct": "mgmt_fee_rate",
                                    "rate_basis": "mgmt_fee_basis", "symbol": "currency_symbol"}).drop("is_current")


# ------------------------------------------------------------ balances and period activity
def opening_balances(s: Star, day: str) -> DataFrame:
    """Commitment plus everything booked before ``day``, per capital account."""
    alloc = before(s["fact_allocation"], "computed_at", day).groupBy(*GRAIN).agg(money_sum("allocated_amount_usd").alias("prior_period_allocations"))
    fees = before(s["fact_fee_charge"], "charge_date", day).groupBy(*GRAIN).agg(money_sum("amount_usd").alias("prior_period_fees"))
    calls = before(s["fact_capital_call"], "call_date", day).groupBy("capital_account_id").agg(money_sum("call_amount_usd").alias("prior_period_contributions"))
    dists = before(s["fact_distribution"], "distribution_date", day).groupBy("capital_account_id").agg(money_sum("amount_usd").alias("prior_period_distributions"))
    rows = join_parts(s["dim_capital_account"], [
        (alloc, GRAIN), (fees, GRAIN), (calls, ["capital_account_id"]), (dists, ["capital_account_id"])])
    parts = [f"prior_period_{p}" for p in ("allocations", "contributions", "distributions", "fees")]
    rows = rows.withColumns({p: F.coalesce(F.col(p), F.lit(0.0)) for p in parts})
    a, k, d, f = (cents(p) for p in parts)
    return rows.withColumn("opening_balance_usd", from_cents(cents("commitment_usd") + a + k - d - f))


def contributions(s: Star, lo: str, hi: str) -> DataFrame:
    rows = within(s["fact_capital_call"], "call_date", lo, hi).groupBy(*GRAIN, "capital_account_id", "status_code").agg(
        money_sum("call_amount_usd").alias("total_contributions_usd"), F.count(F.lit(1)).alias("contribution_count"),
        F.min("call_date").alias("first_call_date"), F.max("call_date").alias("last_call_date"))
    return role_playing(rows, s["ref_status_code"], "status_code", {
        "s": ("status_code", ["status_name"]), "t": ("status_code", ["is_terminal"])}).withColumnsRenamed(
        {"s_status_name": "status_name", "t_is_terminal": "is_terminal"}).drop("status_code")


def distributions(s: Star, lo: str, hi: str) -> DataFrame:
    tier = F.col("waterfall_tier_id")
    rows = within(s["fact_distribution"], "distribution_date", lo, hi).groupBy(
        *GRAIN, "capital_account_id", "waterfall_tier_id", "distribution_method").agg(
        *[sum_where("amount_usd", tier.isin(ids)).alias(f"dist_{n}_usd") for n, ids in TIER_GROUPS.items()],
        money_sum("amount_usd").alias("total_distributions_usd"), money_sum("tax_withholding_usd").alias("total_withholding_usd"),
        F.count(F.lit(1)).alias("distribution_count"))
    return snowflake(rows, [
        (s["dim_waterfall_tier"], "waterfall_tier_id", "tier_id", "inner"),
        (s["ref_distribution_method"], "distribution_method", "method_code", "inner"),
    ]).drop("distribution_method").withColumnRenamed("method_name", "distribution_method_name")


def fees(s: Star, lo: str, hi: str, cost_center: str = "CC-001", approver_role: str = "ROLE-005") -> DataFrame:
    """Fees by type; the statement prints one fixed cost centre and approver role."""
    rows = within(s["fact_fee_charge"], "charge_date", lo, hi).groupBy(*GRAIN, "period_id").agg(
        *[sum_where("amount_usd", F.col("fee_type") == t).alias(f"{t.lower()}_fee_usd") for t in FEE_TYPES],
        money_sum("amount_usd").alias("total_fees_usd"))
    rows = attach_literal(rows, s["dim_cost_center"], "cost_center_code", cost_center)
    return attach_literal(rows, s["dim_employee_role"], "role_code", approver_role).withColumnRenamed("role_name", "fee_approver_role")


def allocations(s: Star, lo: str, hi: str) -> DataFrame:
    kind, amount = F.col("allocation_type"), "allocated_amount_usd"
    names = {"income": "income_alloc_usd", "expense": "expense_alloc_usd", "realized": "realized_gain_usd", "unrealized": "unrealized_gain_usd"}
    accounts = s["dim_account_chart"].join(s["ref_account_type"], "account_type_code").select("account_id", "account_type_name", "normal_balance")
    return within(s["fact_allocation"], "computed_at", lo, hi).join(accounts, "account_id").groupBy(
        *GRAIN, "period_id", "allocation_type", "account_type_name", "normal_balance").agg(
        *[sum_where(amount, kind == ALLOCATION_TYPES[n]).alias(col) for n, col in names.items()],
        money_sum(amount).alias("total_allocations_usd"), money_avg("allocation_pct").alias("avg_allocation_pct"))


def valuations(s: Star, lo: str, hi: str) -> DataFrame:
    """Value range per property of funds that have capital accounts."""
    rows = within(s["fact_valuation"], "valuation_date", lo, hi).groupBy("fund_id", "property_id").agg(
        money_avg("value_usd").alias("avg_value_usd"), F.max("value_usd").alias("max_value_usd"), F.min("value_usd").alias("min_value_usd"),
        F.count(F.lit(1)).alias("valuation_count"), F.min("valuation_date").alias("first_valuation"))
    rows = rows.join(s["dim_capital_account"].select("fund_id").distinct(), "fund_id", "left_semi")
    rows = lag_within(rows, ["property_id"], ["first_valuation", "fund_id"], "avg_value_usd", "prior_value_usd")
    props = property_universe(s).select("property_id", "property_name", "property_type_name", "property_subtype_name",
                                        "property_class_name", "msa_name", "msa_population", "state_name", "property_country_name")
    return rows.join(props, "property_id").drop("first_valuation")


def waterfall_terms(s: Star, carry_code: str = CARRY_CODE) -> DataFrame:
    """Every tier with the terms of one carry structure and what funds of that structure have paid in it."""
    tiers = attach_literal(s["dim_waterfall_tier"], s["ref_carry_structure"], "carry_code", carry_code, "inner")
    funds = s["dim_fund"].where(F.col("carry_code") == carry_code).select("fund_id")
    paid = s["fact_distribution"].join(funds, "fund_id").groupBy(F.col("waterfall_tier_id").alias("tier_id")).agg(
        money_sum("amount_usd").alias("paid_usd"), F.count(F.lit(1)).alias("payments"))
    return tiers.join(paid, "tier_id", "left").withColumns({
        "paid_usd": F.coalesce("paid_usd", F.lit(0.0)), "payments": F.coalesce("payments", F.lit(0))})


def tax_withholding(s: Star, period_distributions: DataFrame, jurisdiction: str = "US_FED", boxes: Sequence[str] = K1_BOXES) -> DataFrame:
    """Withholding of the period next to each K-1 box."""
    total = period_distributions.agg(F.sum(cents("total_withholding_usd")).alias("__c"))
    grid = attach_all(
        s["dim_tax_jurisdiction"].where(F.col("tax_jurisdiction_code") == jurisdiction),
        s["ref_irs_k1_box"].where(F.col("k1_box_code").isin(list(boxes))))
    return attach_all(grid, total).withColumn("total_withholding_usd", from_cents(F.col("__c"))).drop("__c")


def _contribution_totals(s: Star, lo: str, hi: str) -> DataFrame:
    return within(s["fact_capital_call"], "call_date", lo, hi).groupBy(*GRAIN).agg(
        money_sum("call_amount_usd").alias("total_contributions_usd"), F.count(F.lit(1)).alias("contribution_count"),
        F.min("call_date").alias("first_call_date"), F.max("call_date").alias("last_call_date"))


def _distribution_totals(s: Star, lo: str, hi: str) -> DataFrame:
    return within(s["fact_distribution"], "distribution_date", lo, hi).groupBy(*GRAIN).agg(
        money_sum("amount_usd").alias("total_distributions_usd"), money_sum("tax_withholding_usd").alias("total_withholding_usd"))


def _allocation_totals(s: Star, lo: str, hi: str) -> DataFrame:
    known = s["dim_account_chart"].join(s["ref_account_type"], "account_type_code").select("account_id")
    return within(s["fact_allocation"], "computed_at", lo, hi).join(known, "account_id", "left_semi").groupBy(*GRAIN).agg(
        *[sum_where("allocated_amount_usd", F.col("allocation_type") == t).alias(f"{n}_usd") for n, t in ALLOCATION_TYPES.items()],
        money_sum("allocated_amount_usd").alias("total_allocations_usd"))


def _with_metrics(rows: DataFrame) -> DataFrame:
    """Period ratios where a period has both calls and distributions, and the fund's P&L over those rows.

    ``rows`` is read twice, so callers pass a stored frame.
    """
    paid, out = F.col("total_contributions_usd"), F.col("total_distributions_usd")
    both = paid.isNotNull() & out.isNotNull()
    rows = rows.withColumn("__gain", F.when(both, from_cents(cents("realized_usd") + cents("unrealized_usd")))).withColumns({
        "period_dpi": F.when(both, safe_ratio(out, paid)),
        "period_moic": safe_ratio(F.col("__gain"), paid),
        "period_tvpi": safe_ratio(F.col("__gain") + out, paid),
    })
    rows = with_group_value(rows, ["fund_id"], __pl=money_sum("__gain"))
    return rows.withColumn("cumulative_pl_usd", F.when(both, F.col("__pl"))).drop("__gain", "__pl")


def period_metrics(s: Star, lo: str, hi: str) -> DataFrame:
    """Period DPI, MOIC and TVPI per (investor, fund) and the fund's P&L total."""
    rows = _contribution_totals(s, lo, hi).select(*GRAIN, "total_contributions_usd").join(
        _distribution_totals(s, lo, hi).select(*GRAIN, "total_distributions_usd"), GRAIN).join(
        _allocation_totals(s, lo, hi).select(*GRAIN, "realized_usd", "unrealized_usd"), GRAIN, "left")
    return _with_metrics(staged(rows, "period_metrics")).drop("realized_usd", "unrealized_usd")


# ------------------------------------------------------------ the statement
def statement(s: Star, lo: str, hi: str, investor_id: str | None = None) -> DataFrame:
    """One row per (investor, fund, tier paid in the period; a NULL tier if none).

    Closing balance = opening + contributions - distributions + realized +
    unrealized + income - expense - fees, absent components counting as zero.
    """
    profile = investor_profile(s, investor_id).select(
        "investor_id", "investor_name", "investor_type_name", "investor_subtype_name", "country_name", "investor_region",
        "tax_jurisdiction_name", "withholding_rate", "is_accredited")
    funds = fund_universe(s).select(
        "fund_id", "fund_name", "fund_type_name", "is_closed_end", "vintage_year", "market_cycle_phase", "holding_strategy_name",
        "risk_profile", "invest_strategy_name", "pref_return_pct", "gp_carry_pct", "waterfall_type", "mgmt_fee_rate",
        "committed_capital_usd", "inception_date")
    opening = opening_balances(s, lo).select(
        *GRAIN, "commitment_usd", "opening_balance_usd", "prior_period_contributions", "prior_period_distributions")
    fee_totals = within(s["fact_fee_charge"], "charge_date", lo, hi).groupBy(*GRAIN).agg(
        *[sum_where("amount_usd", F.col("fee_type") == t).alias(f"{t.lower()}_fee_usd") for t in FEE_TYPES],
        money_sum("amount_usd").alias("total_fees_usd"))
    tiers = within(s["fact_distribution"], "distribution_date", lo, hi).groupBy(*GRAIN, "waterfall_tier_id").agg(
        money_sum("amount_usd").alias("tier_distributions_usd"), F.count(F.lit(1)).alias("tier_distribution_count"))
    tiers = tiers.join(s["dim_waterfall_tier"], F.col("waterfall_tier_id") == F.col("tier_id")).select(
        *GRAIN, "waterfall_tier_id", "tier_name", "tier_order", "beneficiary", "tier_distributions_usd", "tier_distribution_count")
    rows = join_parts(opening, [
        (_contribution_totals(s, lo, hi), GRAIN), (_distribution_totals(s, lo, hi), GRAIN), (fee_totals, GRAIN),
        (_allocation_totals(s, lo, hi), GRAIN),
    ])
    rows = _with_metrics(staged(rows, "statement"))

    def part(name: str):
        return F.coalesce(cents(name), F.lit(0))

    closing = (part("opening_balance_usd") + part("total_contributions_usd") - part("total_distributions_usd") + part("realized_usd")
               + part("unrealized_usd") + part("income_usd") - part("expense_usd") - part("total_fees_usd"))
    rows = rows.withColumn("computed_ending_balance_usd", from_cents(closing)).join(tiers, GRAIN, "left")
    rows = rows.join(profile, "investor_id").join(funds, "fund_id")
    return attach_all(rows, period_setup(s, lo, hi).select("period_id", "period_label", "fiscal_year", "fiscal_quarter", "quarter_label"))


# ------------------------------------------------------------ precomputed statement
def _activity(s: Star) -> DataFrame:
    """All capital events in one shape: grain, period, kind, cents, cents withheld."""
    def shape(df: DataFrame, day: str, kind, amount: str, withheld=None) -> DataFrame:
        withheld = F.lit(0).cast("long") if withheld is None else withheld
        return df.select(*GRAIN, period_label(F.col(day)).alias("period_id"), kind.alias("kind"), cents(amount).alias("__c"), withheld.alias("__w"))

    known = s["dim_account_chart"].join(s["ref_account_type"], "account_type_code").select("account_id")
    alloc = s["fact_allocation"].join(known, "account_id", "left_semi")
    return (
        shape(s["fact_capital_call"], "call_date", F.lit("CALL"), "call_amount_usd")
        .unionByName(shape(s["fact_distribution"], "distribution_date", F.col("waterfall_tier_id"), "amount_usd", cents("tax_withholding_usd")))
        .unionByName(shape(s["fact_fee_charge"], "charge_date", F.lit("FEE"), "amount_usd"))
        .unionByName(shape(alloc, "computed_at", F.col("allocation_type"), "allocated_amount_usd"))
    )


def investor_pcap(s: Star) -> DataFrame:
    """gold_investor_pcap: all investors, funds and periods with activity, by paid tier (NULL in periods without a distribution).

    One pass: the facts are unioned and folded once to (investor, fund, period);
    opening balances are a running sum over that.
    """
    kind = F.col("kind")

    def total(*kinds: str):
        return F.sum(F.when(kind.isin(*kinds), F.col("__c")).otherwise(F.lit(0)))

    all_tiers = [t for ids in TIER_GROUPS.values() for t in ids]
    per = _activity(s).groupBy(*GRAIN, "period_id").agg(
        total("CALL").alias("calls"), total("FEE").alias("fees"), F.sum("__w").alias("withheld"),
        total(*all_tiers).alias("dist"),
        *[total(*ids).alias(f"dist_{n}") for n, ids in TIER_GROUPS.items()],
        *[total(t).alias(n) for n, t in ALLOCATION_TYPES.items()],
        F.array_sort(F.collect_set(F.when(kind.isin(*all_tiers), kind))).alias("tiers"))
    # expense lowers the balance in both, so that each period opens where the one before it closed
    prior = F.col("calls") - F.col("dist") - F.col("fees") + F.col("income") - F.col("expense") + F.col("realized") + F.col("unrealized")
    earlier = Window.partitionBy(*GRAIN).orderBy("period_id").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("__prior", F.coalesce(F.sum(prior).over(earlier), F.lit(0)))
    per = per.join(s["dim_capital_account"].select(*GRAIN, "commitment_usd"), GRAIN).join(
        s["dim_fund"].select("fund_id", "base_currency"), "fund_id").join(period_rates(s), ["base_currency", "period_id"], "left")
    opening = cents("commitment_usd") + F.col("__prior")
    closing = opening + F.col("calls") - F.col("dist") + F.col("realized") + F.col("unrealized") + F.col("income") - F.col("expense") - F.col("fees")
    gain = from_cents(F.col("realized") + F.col("unrealized"))
    paid, out = from_cents(F.col("calls")), from_cents(F.col("dist"))
    tier = F.explode_outer("tiers")
    return per.select(
        *GRAIN, "period_id", tier.alias("waterfall_tier_id"),
        from_cents(opening).alias("opening_balance_usd"), paid.alias("contributions_usd"),
        *[from_cents(F.col(f"dist_{n}")).alias(f"distributions_{n}") for n in TIER_GROUPS],
        *[from_cents(F.col(n)).alias(f"allocations_{n}") for n in ALLOCATION_TYPES],
        from_cents(F.col("fees")).alias("fees_total"),
        fx_effect(from_cents(F.col("income") + F.col("expense") + F.col("realized") + F.col("unrealized"))).alias("fx_adjustment_usd"),
        from_cents(F.col("withheld")).alias("tax_withholding_usd"), from_cents(closing).alias("closing_balance_usd"),
        safe_ratio(out, paid).alias("period_dpi"), safe_ratio(gain, paid).alias("period_moic"),
        safe_ratio(gain + out, paid).alias("period_tvpi"))


def pcap_report(gold: DataFrame, s: Star, lo: str, hi: str, investor_id: str | None = None) -> DataFrame:
    """The short read of the precomputed statement."""
    rows = gold if investor_id is None else gold.where(F.col("investor_id") == investor_id)
    periods = s["dim_period"].where((F.col("period_start") >= as_date(lo)) & (F.col("period_end") <= as_date(hi))).select("period_id", "period_label")
    investors = s["dim_investor"].where("is_current").join(s["dim_investor_type"], "investor_type_code").select(
        "investor_id", "investor_name", "investor_type_name")
    funds = s["dim_fund"].where("is_current").join(s["dim_fund_type"], "fund_type_code").select(
        "fund_id", "fund_name", "vintage_year", "fund_type_name")
    tiers = s["dim_waterfall_tier"].select(F.col("tier_id").alias("waterfall_tier_id"), F.col("tier_name").alias("waterfall_tier"), "tier_order")
    return (
        rows.join(periods, "period_id").join(investors, "investor_id").join(funds, "fund_id").join(tiers, "waterfall_tier_id", "left")
        .orderBy("investor_id", "fund_id", "period_id", "tier_order")
    )
