"""Fund performance report: flows, NAV, valuations, ratios, attribution, peers.

Facts are reduced to their reporting grain before any dimension or sibling fact
joins, so no join multiplies rows: flows, NAV and ratios live at (fund, period),
valuations and attribution at (fund, property, period), ledger and documents at
fund.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acreledger.functions.money import cents, from_cents, money_avg, money_sum, round_half_up, safe_ratio
from acreledger.functions.scalars import case_ladder, period_label, power_proxy, quarter_number
from acreledger.operators.aggregates import sum_where
from acreledger.operators.distribution import null_safe, percentiles
from acreledger.operators.joins import attach_top1, snowflake
from acreledger.operators.ordering import lag_within, running_sum
from acreledger.operators.predicates import as_date, up_to
from acreledger.session import settings
from acreledger.sources.storage import staged

Star = Mapping[str, DataFrame]

# Quartile labels and report constants.
QUARTILES = ["Q1", "Q2", "Q3", "Q4"]
RATE_SCALE = 100_000
REPORTING_CURRENCY = "USD"
# rows that lie by some of a join's keys stay where they are
STAY = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}
# the report stays below 100 columns, the limit of whole-stage code generation
REPORT_FUND_COLUMNS = [
    "fund_id", "fund_name", "fund_type_name", "is_closed_end", "vintage_year", "market_cycle_phase", "peer_cohort_size",
    "holding_strategy_name", "risk_profile", "invest_strategy_name", "typical_hold_years", "pref_return_pct", "gp_carry_pct",
    "waterfall_type", "mgmt_fee_rate", "mgmt_fee_basis", "base_currency", "committed_capital_usd", "inception_date", "arena_name",
    "arena_region",
]


def for_fund(df: DataFrame, fund_id: str | None) -> DataFrame:
    return df if fund_id is None else df.where(F.col("fund_id") == fund_id)


# ------------------------------------------------------------ dimensions
def fund_metadata(s: Star, fund_id: str | None = None) -> DataFrame:
    """Current funds with their reference attributes."""
    rows = snowflake(for_fund(s["dim_fund"].where("is_current"), fund_id), [
        (s["dim_fund_type"], "fund_type_code", "fund_type_code", "inner"),
        (s["dim_vintage_year"], "vintage_year", "vintage_year", "inner"),
        (s["dim_arena"], "arena_id", "arena_id", "inner"),
        (s["ref_holding_strategy"], "holding_strategy_code", "strategy_code", "left"),
        (s["ref_investment_strategy"], "invest_strategy_code", "invest_strategy_code", "left"),
        (s["ref_carry_structure"], "carry_code", "carry_code", "left"),
        (s["ref_mgmt_fee_schedule"], "mgmt_fee_code", "schedule_code", "left"),
        (s["dim_currency"], "base_currency", "currency_code", "inner"),
    ])
    return (
        rows.withColumnsRenamed({"strategy_name": "holding_strategy_name", "rate_pct": "mgmt_fee_rate",
                                 "rate_basis": "mgmt_fee_basis", "region": "arena_region"})
        .drop("symbol", "is_current")
    )


def property_universe(s: Star) -> DataFrame:
    rows = snowflake(s["dim_property"], [
        (s["dim_property_type"], "property_type_code", "property_type_code", "inner"),
        (s["dim_property_subtype"], "property_subtype_code", "property_subtype_code", "left"),
        (s["ref_property_class"], "property_class_code", "class_code", "left"),
        (s["dim_geography_country"], "country_code", "country_code", "inner"),
        (s["dim_geography_state"], "state_code", "state_code", "left"),
        (s["dim_geography_msa"], "msa_code", "msa_code", "left"),
    ])
    return rows.withColumnsRenamed({"class_name": "property_class_name", "country_name": "property_country_name",
                                    "region": "property_region", "population": "msa_population"}).drop("fund_id")


# ------------------------------------------------------------ flows
def flow_rows(calls: DataFrame, dists: DataFrame, fees: DataFrame) -> DataFrame:
    """(fund_id, flow_date, period_id, flow_type, flow_usd) from the three flow facts."""
    return (
        calls.select("fund_id", F.col("call_date").alias("flow_date"), period_label(F.col("call_date")).alias("period_id"),
                     F.lit("CONTRIBUTION").alias("flow_type"), F.col("call_amount_usd").alias("flow_usd"))
        .unionByName(dists.select("fund_id", F.col("distribution_date").alias("flow_date"),
                                  period_label(F.col("distribution_date")).alias("period_id"),
                                  F.concat(F.lit("DISTRIBUTION_"), F.col("waterfall_tier_id")).alias("flow_type"),
                                  F.col("amount_usd").alias("flow_usd")))
        .unionByName(fees.select("fund_id", F.col("charge_date").alias("flow_date"), "period_id",
                                 F.lit("FEE").alias("flow_type"), F.col("amount_usd").alias("flow_usd")))
    )


def cash_flow_history(calls: DataFrame, dists: DataFrame, fees: DataFrame, as_of: str, fund_id: str | None = None) -> DataFrame:
    """Flows per (fund, period, type): one shuffle for all three facts."""
    rows = up_to(for_fund(flow_rows(calls, dists, fees), fund_id), "flow_date", as_of)
    return rows.groupBy("fund_id", "period_id", "flow_type").agg(money_sum("flow_usd").alias("flow_usd"))


def cumulative_flows(history: DataFrame) -> DataFrame:
    """Period and running totals; takes the history or, sparing a shuffle, the flow rows themselves."""
    per = history.groupBy("fund_id", "period_id").agg(
        sum_where("flow_usd", F.col("flow_type") == "CONTRIBUTION").alias("contrib_usd"),
        sum_where("flow_usd", F.col("flow_type").startswith("DISTRIBUTION")).alias("dist_usd"),
        sum_where("flow_usd", F.col("flow_type") == "FEE").alias("fee_usd"),
    )
    per = running_sum(per, ["fund_id"], "period_id", "contrib_usd", "cumulative_contrib_usd")
    return running_sum(per, ["fund_id"], "period_id", "dist_usd", "cumulative_dist_usd")


def nav_series(nav: DataFrame, as_of: str, fund_id: str | None = None) -> DataFrame:
    per = up_to(for_fund(nav, fund_id), "snapshot_date", as_of).groupBy("fund_id", "period_id").agg(
        money_avg("gross_nav_usd").alias("gross_nav"), money_avg("net_nav_usd").alias("net_nav"),
        money_avg("nav_per_unit").alias("nav_per_unit"), F.sum("total_units").alias("total_units"))
    return lag_within(per, ["fund_id"], ["period_id"], "net_nav", "prior_net_nav")


def valuation_history(valuations: DataFrame, as_of: str, fund_id: str | None = None) -> DataFrame:
    """Value per property, period and method, with the property's previous row."""
    per = up_to(for_fund(valuations, fund_id), "valuation_date", as_of).groupBy(
        "fund_id", "property_id", "period_id", "valuation_method").agg(
        money_avg("value_usd").alias("period_value_usd"), F.max("valuation_date").alias("latest_val_date"))
    per = lag_within(per, ["property_id"], ["period_id", "valuation_method"], "period_value_usd", "prior_value_usd")
    return per.withColumn("value_change_usd", F.col("period_value_usd") - F.col("prior_value_usd"))


def with_ratios(rows: DataFrame) -> DataFrame:
    """DPI, TVPI, RVPI and the IRR proxy (total value / paid in) ** 0.25 - 1 on (fund, period) rows."""
    paid, out, net = F.col("cumulative_contrib_usd"), F.col("cumulative_dist_usd"), F.col("net_nav")
    return rows.withColumns({
        "dpi": safe_ratio(out, paid), "tvpi": safe_ratio(out + net, paid), "rvpi": safe_ratio(net, paid),
    }).withColumn("irr_proxy", round_half_up(power_proxy(F.col("tvpi")), 6))


def ratios(cumulative: DataFrame, nav: DataFrame) -> DataFrame:
    joined = cumulative.join(nav.select("fund_id", "period_id", "net_nav"), ["fund_id", "period_id"], "left")
    return with_ratios(joined.select("fund_id", "period_id", "cumulative_contrib_usd", "cumulative_dist_usd", "net_nav"))


# ------------------------------------------------------------ attribution and peers
def property_attribution(s: Star, as_of: str, fund_id: str | None = None) -> DataFrame:
    """P&L per (fund, property, period) by allocation type."""
    rows = up_to(for_fund(s["fact_allocation"], fund_id), "computed_at", as_of)
    known = s["dim_account_chart"].join(s["ref_account_type"], "account_type_code").select("account_id")
    kind, amount = F.col("allocation_type"), "allocated_amount_usd"
    return rows.join(known, "account_id").groupBy("fund_id", "property_id", "period_id").agg(
        money_sum(amount).alias("property_pl_usd"),
        sum_where(amount, kind == "REALIZED_GAIN").alias("realized_pl"),
        sum_where(amount, kind == "UNREALIZED_GAIN").alias("unrealized_pl"),
        sum_where(amount, kind == "INCOME").alias("income_pl"),
        sum_where(amount, kind == "EXPENSE").alias("expense_pl"))


def vintage_cohorts(s: Star) -> DataFrame:
    """Cohort size and committed-capital quartiles per vintage of current funds."""
    funds = s["dim_fund"].where("is_current").join(s["dim_vintage_year"].select("vintage_year"), "vintage_year", "left_semi")
    size = funds.groupBy("vintage_year").agg(F.countDistinct("fund_id").alias("cohort_size"))
    cuts = percentiles(funds, ["vintage_year"], "committed_capital_usd", {"p25_committed": 0.25, "p50_committed": 0.5, "p75_committed": 0.75})
    return size.join(cuts, "vintage_year", "left")


def committed_capital_quartiles(s: Star) -> DataFrame:
    """Each current fund against its vintage (by committed capital)."""
    funds = s["dim_fund"].where("is_current").select("fund_id", "vintage_year", "committed_capital_usd")
    return funds.join(vintage_cohorts(s), "vintage_year").withColumn("peer_quartile", committed_quartile())


def committed_quartile() -> Column:
    cuts = [F.col(f"p{p}_committed") for p in (25, 50, 75)]
    return case_ladder(F.col("committed_capital_usd"), cuts, QUARTILES)


def fx_stats(s: Star, lo: str | None = None, hi: str | None = None) -> DataFrame:
    """Average, spread and range of rates per currency pair."""
    rates = s["fact_fx_rate"]
    if lo is not None:
        rates = rates.where(F.col("rate_date") >= as_date(lo))
    if hi is not None:
        rates = up_to(rates, "rate_date", hi)
    return rates.join(s["ref_currency_pair"], "pair_code").groupBy("base_currency", "quote_currency", "is_active").agg(
        money_avg("rate", RATE_SCALE).alias("avg_rate"), round_half_up(F.stddev_samp("rate"), 6).alias("rate_stddev"),
        F.min("rate").alias("min_rate"), F.max("rate").alias("max_rate"))


# ------------------------------------------------------------ ledger, audit, documents
def gl_attribution(s: Star, lo: str | None = None, hi: str | None = None, fund_id: str | None = None,
                   funds: DataFrame | None = None) -> DataFrame:
    """Ledger by account, type, currency, status and approval tier.

    Rows are folded to their code combination first; the snowflake then joins
    a few rows per fund instead of the ledger.
    """
    gl = for_fund(s["fact_gl_transaction"], fund_id)
    if lo is not None:
        gl = gl.where(F.col("transaction_date") >= as_date(lo))
    if hi is not None:
        gl = up_to(gl, "transaction_date", hi)
    codes = ["fund_id", "account_id", "transaction_type_code", "currency_code", "status_code", "approval_chain_code"]
    folded = gl.groupBy(*codes).agg(F.sum(cents("amount_usd")).alias("__c"), F.count(F.lit(1)).alias("__n"))
    if funds is not None:
        folded = folded.join(funds, "fund_id", "left_semi")
    named = snowflake(folded, [
        (s["dim_account_chart"], "account_id", "account_id", "inner"),
        (s["ref_account_type"], "account_type_code", "account_type_code", "inner"),
        (s["ref_transaction_type"], "transaction_type_code", "transaction_type_code", "inner"),
        (s["dim_currency"], "currency_code", "currency_code", "inner"),
        (s["ref_status_code"], "status_code", "status_code", "inner"),
        (s["ref_approval_chain"], "approval_chain_code", "approval_tier_code", "left"),
    ])

    def part(cond: Column) -> Column:
        return from_cents(F.sum(F.when(cond, F.col("__c")).otherwise(F.lit(0))))

    kind, group = F.col("account_type_code"), F.col("category")
    return named.groupBy("fund_id", "account_id", "account_name", "account_type_name", "normal_balance", "transaction_type_name",
                         "category", F.col("currency_name").alias("txn_currency"), F.col("status_name").alias("txn_status"),
                         "approval_tier_name").agg(
        from_cents(F.sum("__c")).alias("total_gl_usd"),
        part(kind == "REVENUE").alias("revenue_usd"), part(kind == "EXPENSE").alias("expense_usd"),
        part(kind.isin("REVENUE", "EXPENSE")).alias("noi_usd"),
        part(group == "CAPITAL").alias("capital_usd"), part(group == "OPERATING").alias("operating_usd"),
        part(group == "INVESTMENT").alias("investment_usd"), part(group == "FINANCING").alias("financing_usd"),
        F.sum("__n").alias("txn_count"))


def audit_summary(s: Star, entity_types: Sequence[str], lo: str | None = None, hi: str | None = None) -> DataFrame:
    """Events by entity, type and role; unknown roles are kept with a NULL name."""
    rows = s["fact_audit_event"].where(F.col("entity_type").isin(list(entity_types)))
    if lo is not None:
        rows = rows.where(F.col("event_date") >= as_date(lo))
    if hi is not None:
        rows = rows.where(F.col("event_date") <= as_date(hi))
    folded = rows.groupBy("entity_type", "event_type", "role_code").agg(
        F.count(F.lit(1)).alias("__n"), F.min("event_timestamp").alias("__lo"), F.max("event_timestamp").alias("__hi"))
    return folded.join(s["dim_employee_role"], "role_code", "left").groupBy("entity_type", "event_type", "role_name").agg(
        F.sum("__n").alias("event_count"), F.min("__lo").alias("first_event"), F.max("__hi").alias("last_event"))


def document_summary(s: Star, fund_id: str | None = None) -> DataFrame:
    rows = for_fund(s["fact_document_metadata"], fund_id).groupBy("fund_id", "doc_type_code").agg(
        F.count(F.lit(1)).alias("doc_count"), F.sum("file_size_bytes").alias("__bytes"), F.sum("page_count").alias("total_pages"))
    return rows.join(s["dim_document_type"], "doc_type_code").select(
        "fund_id", "doc_type_name", "doc_count",
        (F.col("__bytes").cast("double") / F.lit(1024.0) / F.lit(1024.0)).alias("total_mb"), "total_pages")


# ------------------------------------------------------------ the composed report
def _fund_period(s: Star, as_of: str, fund_id: str | None) -> DataFrame:
    """Flows, NAV and ratios side by side at (fund, period).

    The spine is every period of a fund with a flow or a NAV: a NAV adds an empty
    flow, so that running totals carry into periods without one.
    """
    empty = s["fact_nav_snapshot"].select("fund_id", F.col("snapshot_date").alias("flow_date"), "period_id", F.lit("NONE").alias("flow_type"), F.lit(0.0).alias("flow_usd"))
    rows = flow_rows(s["fact_capital_call"], s["fact_distribution"], s["fact_fee_charge"]).unionByName(empty)
    flows = cumulative_flows(up_to(for_fund(rows, fund_id), "flow_date", as_of))
    nav = nav_series(s["fact_nav_snapshot"], as_of, fund_id)
    return with_ratios(flows.join(nav, ["fund_id", "period_id"], "left"))


def _property_period(s: Star, as_of: str, fund_id: str | None) -> DataFrame:
    """Valuation and attribution at (fund, property, period).

    These facts are the report's spine: pairing every fund with every property of
    its tenant would add only empty rows.
    """
    value = (
        up_to(for_fund(s["fact_valuation"], fund_id), "valuation_date", as_of)
        .groupBy("fund_id", "property_id", "period_id").agg(money_avg("value_usd").alias("period_value_usd"))
    )
    value = lag_within(value, ["property_id"], ["period_id"], "period_value_usd", "prior_value_usd").withColumn(
        "value_change_usd", F.col("period_value_usd") - F.col("prior_value_usd"))
    return value.join(property_attribution(s, as_of, fund_id), ["fund_id", "property_id", "period_id"], "full_outer")


def fund_rollup(s: Star, as_of: str, entity_types: Sequence[str], fund_id: str | None = None) -> DataFrame:
    """The board report at (fund, property, period)."""
    ledger = gl_attribution(s, hi=as_of, fund_id=fund_id).groupBy("fund_id").agg(
        money_sum("total_gl_usd").alias("total_gl_usd"), money_sum("revenue_usd").alias("gl_revenue"),
        money_sum("expense_usd").alias("gl_expense"), money_sum("noi_usd").alias("gl_noi"), F.sum("txn_count").alias("gl_txn_count"))
    docs = for_fund(s["fact_document_metadata"], fund_id).join(
        s["dim_document_type"].select("doc_type_code"), "doc_type_code", "left_semi").groupBy("fund_id").agg(
        F.count(F.lit(1)).alias("doc_count"), F.sum("page_count").alias("doc_total_pages"))
    fx = fx_stats(s, hi=as_of).where(F.col("quote_currency") == REPORTING_CURRENCY).select("base_currency", F.col("avg_rate").alias("fx_avg_rate"), F.col("rate_stddev").alias("fx_volatility"))
    audit = audit_summary(s, entity_types, hi="9999-12-31").select(
        F.col("entity_type").alias("audit_entity_type"), F.col("event_type").alias("audit_event_type"),
        F.col("role_name").alias("audit_user_role"), F.col("event_count").alias("audit_event_count"))
    # fund-level context first (small), then one join to the property rows
    funds = (
        fund_metadata(s, fund_id).select(*REPORT_FUND_COLUMNS)
        .join(vintage_cohorts(s), "vintage_year", "left").withColumn("peer_quartile", committed_quartile())
        .join(fx, "base_currency", "left").join(ledger, "fund_id", "left").join(docs, "fund_id", "left")
    )
    funds = attach_top1(funds, audit, [F.desc("audit_event_count"), F.col("audit_entity_type"), F.col("audit_event_type"),
                                       F.asc_nulls_first("audit_user_role")])
    props = property_universe(s).select(
        "property_id", "property_name", "property_type_name", "property_subtype_name", "property_class_name", "quality_rank",
        "property_country_name", "state_name", "msa_name", "msa_population", "acquisition_date", "acquisition_price_usd",
        "square_feet", "units")
    # the facts meet the properties while they are narrow; all that hangs on (fund, period) meets there, few
    # rows, and comes last, so that its many columns aren't shuffled with the facts
    facts = staged(_property_period(s, as_of, fund_id), "property_period")
    around = (
        facts.select("fund_id", "period_id").distinct()
        .join(_fund_period(s, as_of, fund_id), ["fund_id", "period_id"], "left").join(funds, "fund_id")
    )
    # written first: what its folds shuffle is off the disk before the facts move
    around = staged(around, "fund_period")
    return null_safe(facts.join(props, "property_id", "left"), around, ["fund_id", "period_id"])


# ------------------------------------------------------------ precomputed report
def period_rates(s: Star) -> DataFrame:
    """(base_currency, period_id, rate_delta): period average minus overall average of the rates to the reporting currency."""
    rates = s["fact_fx_rate"].where(F.col("quote_currency") == REPORTING_CURRENCY).withColumn("period_id", period_label(F.col("rate_date")))
    per = rates.groupBy("base_currency", "period_id").agg(money_avg("rate", RATE_SCALE).alias("__p"))
    overall = rates.groupBy("base_currency").agg(money_avg("rate", RATE_SCALE).alias("__o"))
    return per.join(overall, "base_currency").select("base_currency", "period_id", (F.col("__p") - F.col("__o")).alias("rate_delta"))


def fx_effect(amount: Column) -> Column:
    """Amount times the rate's deviation; zero for dollar funds and unquoted periods."""
    return round_half_up(F.when(F.col("base_currency") == REPORTING_CURRENCY, F.lit(0.0)).otherwise(
        F.coalesce(amount * F.col("rate_delta"), F.lit(0.0))), 2)


def attribution_period(s: Star, as_of: str) -> DataFrame:
    """gold_fund_attribution_period: every (fund, property, period) with a valuation or an allocation."""
    fund = _fund_period(s, as_of, None)
    # four quarters by the calendar, whatever periods the fund skips
    year = Window.partitionBy("fund_id").orderBy(quarter_number(F.col("period_id"))).rangeBetween(-3, 0)
    fund = fund.withColumns({
        "__c4": F.sum(cents("contrib_usd")).over(year), "__d4": F.sum(cents("dist_usd")).over(year)})
    trailing = safe_ratio(from_cents(F.col("__d4")) + F.col("net_nav"), from_cents(F.col("__c4")))
    meta = s["dim_fund"].select("fund_id", "vintage_year", "base_currency")
    fund = fund.join(meta.drop("base_currency"), "fund_id").withColumn("fund_irr_trailing_12m", round_half_up(power_proxy(trailing), 6))
    # read by the peer ranking and the final join: write it once
    fund = staged(fund, "fund_period")
    cohort = ["vintage_year", "period_id"]
    # exact percentiles of both ratios in one pass; a cohort has at most one row for each fund
    at = F.array(*(F.lit(p) for p in (0.25, 0.5, 0.75)))
    cuts = fund.groupBy(*cohort).agg(F.percentile("irr_proxy", at).alias("__irr"), F.percentile("tvpi", at).alias("__moic"))
    fund = null_safe(fund, cuts, cohort, "left")
    for name, col in (("irr", "irr_proxy"), ("moic", "tvpi")):
        label = case_ladder(F.col(col), [F.col(f"__{name}")[n] for n in range(3)], QUARTILES)
        fund = fund.withColumn(f"peer_quartile_{name}", F.when(F.col(col).isNotNull(), label))
    # read for the fund-period total and for the rows themselves
    facts = staged(_property_period(s, as_of, None), "property_period")
    # all that hangs on (fund, period) meets there, few rows; the facts are shuffled once, for one join
    around = (
        facts.groupBy("fund_id", "period_id").agg(money_sum("property_pl_usd").alias("__total"))
        .join(fund, ["fund_id", "period_id"], "left").join(meta.select("fund_id", "base_currency"), "fund_id")
        .join(s["dim_period"].select("period_id", "period_label", "period_end"), "period_id", "left")
        .join(period_rates(s), ["base_currency", "period_id"], "left")
    )
    return (
        null_safe(facts, around, ["fund_id", "period_id"])
        .select(
            "fund_id", "property_id", "period_id", "period_label", "period_end",
            F.col("irr_proxy").alias("fund_irr_net"), "fund_irr_trailing_12m", F.col("tvpi").alias("moic_net"),
            F.col("tvpi").alias("tvpi_net"), F.col("dpi").alias("dpi_net"), F.col("rvpi").alias("rvpi_net"),
            round_half_up(safe_ratio(F.col("property_pl_usd"), F.col("__total")), 6).alias("property_contribution_pct"),
            F.col("property_pl_usd").alias("property_attribution_usd"), "peer_quartile_irr", "peer_quartile_moic",
            round_half_up(F.col("__irr")[1], 6).alias("vintage_cohort_median_irr"),
            F.col("value_change_usd").alias("gross_appreciation_usd"),
            fx_effect(F.col("property_pl_usd")).alias("fx_drag_usd"), "gross_nav", "net_nav")
    )


def attribution_report(gold: DataFrame, s: Star, as_of: str, fund_id: str | None = None) -> DataFrame:
    """The short read of the precomputed report.

    Its rows are many and wide, and pack well only next to others of their (fund,
    period), whose figures they repeat. So they move to their (fund, period) and stay
    there: what hangs on the fund meets the few (fund, period), property names meet the
    keys alone, and both come to the rows. The result is written once, as an order
    reads its input twice.
    """
    funds = s["dim_fund"].where("is_current").join(s["dim_fund_type"], "fund_type_code").join(
        s["ref_holding_strategy"], F.col("holding_strategy_code") == F.col("strategy_code"), "left").select(
        "fund_id", "fund_name", "vintage_year", "fund_type_name", F.col("strategy_name").alias("holding_strategy_name"))
    props = s["dim_property"].join(s["dim_property_type"], "property_type_code").select(
        "property_id", "property_name", "property_type_name", "msa_code")
    # a place to meet, not a value: rows without a period have one too
    rows = up_to(for_fund(gold, fund_id), "period_end", as_of).withColumn("__at", F.coalesce("period_id", F.lit("")))
    around = rows.select("fund_id", "__at").distinct().join(funds, "fund_id")
    named = rows.select("fund_id", "__at", "property_id").distinct().join(props, "property_id")
    placed = rows.join(around, ["fund_id", "__at"]).join(named, ["fund_id", "__at", "property_id"])
    shown = ["property_id", "fund_id", *[c for c in placed.columns if c not in ("property_id", "fund_id", "__at")]]
    with settings(gold.sparkSession, STAY):
        report = staged(placed.select(*shown), "attribution_report")
    return report.orderBy("fund_id", "period_id", "property_id")
