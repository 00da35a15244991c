"""Silver, gold, workload, dashboards, lookups: queries and oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from acreledger.functions.scalars import month_date
from acreledger.plans import dashboards as dash
from acreledger.plans import gold, silver, workload
from acreledger.testbed.registry import AS_OF, TENANT, c, define, mavg, msum, mwhere, query, rnd

# ------------------------------------------------------------ silver
define("silver_arenas", "SELECT arena_id, arena_name, tier FROM arenas WHERE arena_id IS NOT NULL")
define("silver_funds", """SELECT fund_id, arena_id, fund_name, vintage_year, lower(strategy) AS strategy, aum, status
  FROM funds WHERE fund_id IS NOT NULL AND arena_id IS NOT NULL""")
define("silver_investors", """SELECT investor_id, arena_id, investor_name, lower(type) AS type, commitment_amount, fund_id, city, state
  FROM investors WHERE investor_id IS NOT NULL AND arena_id IS NOT NULL""")
define("silver_properties", """SELECT *, current_valuation - acquisition_price AS unrealized_gain FROM properties
  WHERE property_id IS NOT NULL AND arena_id IS NOT NULL""")
define("silver_gl", """SELECT * EXCLUDE (rn), CAST(year(transaction_date) AS INT) AS fiscal_year,
    CAST(quarter(transaction_date) AS INT) AS fiscal_quarter, category IN ('opex','capex','debt_service') AS is_expense
  FROM (SELECT g.*, row_number() OVER (PARTITION BY transaction_id ORDER BY transaction_date, amount, arena_id, property_id,
        fund_id, account_code, description, category, posted, currency, approval_status, counterparty_id) AS rn
        FROM gl_raw g WHERE transaction_id IS NOT NULL AND amount IS NOT NULL AND arena_id IS NOT NULL) d WHERE rn = 1""")

query("prj_silver_arenas", "SELECT * FROM silver_arenas")(lambda x: silver.arenas(x.t.arenas))
query("prj_silver_funds", "SELECT * FROM silver_funds")(lambda x: silver.funds(x.t.funds))
query("prj_silver_investors", "SELECT * FROM silver_investors")(lambda x: silver.investors(x.t.investors))
query("prj_silver_properties", "SELECT * FROM silver_properties")(lambda x: silver.properties(x.t.properties))
query("prj_silver_gl", "SELECT * FROM silver_gl")(lambda x: silver.gl_transactions(x.t.gl_raw))

# ------------------------------------------------------------ gold
define("gold_fund", f"""SELECT f.arena_id, f.fund_id, f.fund_name, f.strategy, f.aum AS total_aum, property_count, total_invested,
    current_portfolio_value, unrealized_gain_loss, investor_count, total_commitments
  FROM silver_funds f
  LEFT JOIN (SELECT fund_id, COUNT(property_id) AS property_count, {msum("acquisition_price")} AS total_invested,
      {msum("current_valuation")} AS current_portfolio_value, {msum("unrealized_gain")} AS unrealized_gain_loss
    FROM silver_properties GROUP BY fund_id) p ON p.fund_id = f.fund_id
  LEFT JOIN (SELECT fund_id, COUNT(investor_id) AS investor_count, {msum("commitment_amount")} AS total_commitments
    FROM silver_investors GROUP BY fund_id) i ON i.fund_id = f.fund_id""")
define("gold_property", f"""SELECT g.arena_id, g.property_id, property_name, property_type, p.fund_id, fund_name, month,
    revenue, expenses, CAST({c("revenue")} - {c("expenses")} AS DOUBLE) / 100e0 AS noi, occupancy_rate
  FROM (SELECT arena_id, property_id, CAST(date_trunc('month', transaction_date) AS DATE) AS month,
      {mwhere("amount", "category = 'revenue'")} AS revenue, {mwhere("amount", "is_expense")} AS expenses
    FROM silver_gl GROUP BY ALL) g
  LEFT JOIN silver_properties p ON p.property_id = g.property_id
  LEFT JOIN silver_funds f ON f.fund_id = p.fund_id""")
define("gold_investor", f"""SELECT i.arena_id, investor_id, investor_name, type, city, state,
    COUNT(i.fund_id) AS fund_commitment_count, {msum("commitment_amount")} AS total_committed,
    array_to_string(list_sort(list(DISTINCT fund_name) FILTER (fund_name IS NOT NULL)), ', ') AS fund_names
  FROM silver_investors i LEFT JOIN silver_funds f ON f.fund_id = i.fund_id
  GROUP BY i.arena_id, investor_id, investor_name, type, city, state""")
define("gold_gl", f"""SELECT g.arena_id, g.fund_id, fund_name, category, month, total_amount, transaction_count, avg_transaction_amount
  FROM (SELECT arena_id, fund_id, category, CAST(date_trunc('month', transaction_date) AS DATE) AS month,
      {msum("amount")} AS total_amount, COUNT(transaction_id) AS transaction_count, {mavg("amount")} AS avg_transaction_amount
    FROM silver_gl GROUP BY ALL) g
  LEFT JOIN silver_funds f ON f.fund_id = g.fund_id""")
define("gold_arena", f"""SELECT a.arena_id, arena_name, total_aum, total_properties, total_investors, total_commitments,
    total_revenue, CAST({c("total_revenue")} - {c("total_exp")} AS DOUBLE) / 100e0 AS total_noi
  FROM silver_arenas a
  LEFT JOIN (SELECT arena_id, {msum("aum")} AS total_aum FROM silver_funds GROUP BY 1) f ON f.arena_id = a.arena_id
  LEFT JOIN (SELECT arena_id, COUNT(DISTINCT property_id) AS total_properties FROM silver_properties GROUP BY 1) p
    ON p.arena_id = a.arena_id
  LEFT JOIN (SELECT arena_id, COUNT(DISTINCT investor_id) AS total_investors, {msum("commitment_amount")} AS total_commitments
    FROM silver_investors GROUP BY 1) i ON i.arena_id = a.arena_id
  LEFT JOIN (SELECT arena_id, {mwhere("amount", "category = 'revenue'")} AS total_revenue, {mwhere("amount", "is_expense")} AS total_exp
    FROM silver_gl WHERE transaction_date >= DATE '{AS_OF}' - INTERVAL 12 MONTH GROUP BY 1) g ON g.arena_id = a.arena_id""")


def month_as_date(df):
    return df.withColumn("month", month_date(F.col("month")))


# the gold_* queries compute from raw rows; everything below reads the written gold tables
@query("gold_fund_performance", "SELECT * FROM gold_fund")
def _(x):
    return gold.fund_performance(silver.funds(x.t.funds), silver.properties(x.t.properties), silver.investors(x.t.investors))


@query("gold_property_financials", "SELECT * FROM gold_property")
def _(x):
    return month_as_date(gold.property_financials(
        silver.properties(x.t.properties), silver.funds(x.t.funds), silver.gl_transactions(x.t.gl_raw, silver.MEASURED)))


@query("gold_investor_portfolio", "SELECT * FROM gold_investor")
def _(x):
    return gold.investor_portfolio(silver.investors(x.t.investors), silver.funds(x.t.funds))


@query("gold_gl_monthly_summary", "SELECT * FROM gold_gl")
def _(x):
    return month_as_date(gold.gl_monthly_summary(silver.gl_transactions(x.t.gl_raw, silver.MEASURED), silver.funds(x.t.funds)))


@query("gold_arena_overview", "SELECT * FROM gold_arena")
def _(x):
    return gold.arena_overview(silver.arenas(x.t.arenas), silver.funds(x.t.funds), silver.properties(x.t.properties),
                               silver.investors(x.t.investors), silver.gl_transactions(x.t.gl_raw, silver.MEASURED), AS_OF)


# ------------------------------------------------------------ workload
@query("q1_fund_performance_arena", f"SELECT * FROM gold_fund WHERE arena_id = '{TENANT}'")
def _(x):
    return workload.fund_performance_arena(x.gold("fund_performance"), TENANT)


@query("q2_gl_monthly_by_arena_year", f"""
SELECT category, month, {msum("total_amount")} AS total_amount, CAST(SUM(transaction_count) AS BIGINT) AS transaction_count,
  {rnd(mavg("avg_transaction_amount", "1000000e0"), 2)} AS avg_transaction_amount,
  {rnd(f"CAST(SUM({c('total_amount')}) AS DOUBLE) / CAST(SUM(transaction_count) AS DOUBLE) / 100e0", 2)} AS weighted_avg_amount
FROM gold_gl WHERE arena_id = '{TENANT}' AND month >= DATE '{AS_OF}' - INTERVAL 12 MONTH GROUP BY category, month""")
def _(x):
    return workload.gl_monthly_by_arena_year(x.gold("gl_monthly_summary"), TENANT, AS_OF)


@query("q3_property_financials_joined", f"""
SELECT property_id, property_name, property_type, arena_name, tier, f.fund_name, strategy, month, revenue, expenses, noi, occupancy_rate
FROM gold_property p JOIN silver_arenas a ON a.arena_id = p.arena_id
JOIN silver_funds f ON f.fund_id = p.fund_id AND f.arena_id = p.arena_id
WHERE p.arena_id = '{TENANT}' AND month >= DATE '{AS_OF}' - INTERVAL 6 MONTH
ORDER BY month DESC, noi DESC, property_id LIMIT 100""")
def _(x):
    return workload.property_financials_joined(x.gold("property_financials"), x.silver("arenas"), x.silver("funds"), TENANT, AS_OF)


@query("q4_top10_properties", f"""
SELECT * FROM (SELECT *, CAST(rank() OVER (ORDER BY revenue_ttm DESC) AS INT) AS revenue_rank FROM (
  SELECT property_id, property_name, property_type, fund_name, {msum("revenue")} AS revenue_ttm, {msum("noi")} AS noi_ttm,
    {mavg("occupancy_rate")} AS avg_occupancy
  FROM gold_property WHERE arena_id = '{TENANT}' AND month >= DATE '{AS_OF}' - INTERVAL 12 MONTH GROUP BY ALL) t) r
WHERE revenue_rank <= 10 ORDER BY revenue_rank, property_id LIMIT 10""")
def _(x):
    return workload.top_properties_by_revenue(x.gold("property_financials"), TENANT, AS_OF)


@query("q5_pnl_rollup_multi_month", f"""
SELECT *, CAST({c("revenue")} - {c("expenses")} AS DOUBLE) / 100e0 AS net_income FROM (
  SELECT f.fund_id, f.fund_name, strategy, vintage_year, month, {mwhere("total_amount", "category = 'revenue'")} AS revenue,
    {mwhere("total_amount", "category <> 'revenue'")} AS expenses, CAST(SUM(transaction_count) AS BIGINT) AS transaction_count,
    {rnd(mavg("avg_transaction_amount", "1000000e0"), 2)} AS avg_txn_amount
  FROM gold_gl g JOIN silver_funds f ON f.fund_id = g.fund_id AND f.arena_id = g.arena_id
  WHERE g.arena_id = '{TENANT}' AND month >= DATE '{AS_OF}' - INTERVAL 24 MONTH GROUP BY ALL) r""")
def _(x):
    return workload.pnl_rollup(x.gold("gl_monthly_summary"), x.silver("funds"), TENANT, AS_OF)


@query("q6_investor_commitments", f"""
SELECT investor_id, investor_name, type, city, state, {msum("commitment_amount")} AS total_commitment,
  COUNT(DISTINCT i.fund_id) AS fund_count, array_to_string(list_sort(list(DISTINCT fund_name)), '|') AS funds
FROM silver_investors i JOIN silver_funds f ON f.fund_id = i.fund_id AND f.arena_id = i.arena_id
WHERE i.arena_id = '{TENANT}' GROUP BY investor_id, investor_name, type, city, state""")
def _(x):
    out = workload.investor_commitments(x.silver("investors"), x.silver("funds"), TENANT)
    return out.withColumn("funds", F.array_join("funds", "|"))


define("annual_revenue", f"""SELECT g.property_id, fiscal_year, {mwhere("amount", "category = 'revenue'")} AS rev,
    COUNT(DISTINCT counterparty_id) AS counterparty_count
  FROM silver_gl g JOIN silver_properties p ON p.property_id = g.property_id JOIN silver_funds f ON f.fund_id = g.fund_id
  WHERE fiscal_year BETWEEN 1998 AND 2001 AND approval_status = 'approved' AND currency = 'USD'
  GROUP BY g.property_id, fiscal_year""")


@query("q7_yoy_growth", """
SELECT * FROM (SELECT *, CAST(rank() OVER (PARTITION BY fiscal_year ORDER BY yoy_growth DESC) AS INT) AS rnk FROM (
  SELECT *, (rev - prev_rev) / NULLIF(prev_rev, 0) AS yoy_growth FROM (
    SELECT *, LAG(rev) OVER (PARTITION BY property_id ORDER BY fiscal_year) AS prev_rev FROM annual_revenue) l) g
  WHERE yoy_growth IS NOT NULL) r
WHERE rnk <= 100 ORDER BY fiscal_year DESC, rnk, property_id LIMIT 300""")
def _(x):
    return workload.yoy_growth(x.silver("gl_transactions"), x.silver("properties"), x.silver("funds"), 2001)


FUND = "Supplier#000000005"


@query("serve_gl_by_fund", f"SELECT fund_name, category, month, total_amount FROM gold_gl WHERE fund_name = '{FUND}'")
def _(x):
    return workload.gl_by_fund(x.gold("gl_monthly_summary"), FUND)


@query("serve_top_funds", "SELECT * FROM gold_fund ORDER BY total_aum DESC, fund_id LIMIT 20")
def _(x):
    return workload.top_funds(x.gold("fund_performance"))


@query("serve_noi_trend", f"SELECT property_id, property_name, month, noi FROM gold_property WHERE fund_name = '{FUND}'")
def _(x):
    return workload.property_noi_trend(x.gold("property_financials"), FUND)


# ------------------------------------------------------------ dashboards
GF, GP, GG = "fund_performance", "property_financials", "gl_monthly_summary"

query("dash_fund_summary", """SELECT fund_name, strategy, total_aum, property_count, total_invested, current_portfolio_value,
  unrealized_gain_loss, investor_count, total_commitments FROM gold_fund""")(lambda x: dash.fund_summary(x.gold(GF)))
query("dash_fund_kpis", f"""SELECT COUNT(*) AS fund_count, {msum("total_aum")} AS total_aum, {msum("total_invested")} AS total_invested,
  {msum("current_portfolio_value")} AS total_portfolio_value, {msum("unrealized_gain_loss")} AS total_gain_loss,
  CAST(SUM(investor_count) AS BIGINT) AS total_investors FROM gold_fund""")(lambda x: dash.fund_kpis(x.gold(GF)))
query("dash_aum_by_strategy", f"""SELECT strategy, {msum("total_aum")} AS total_aum, COUNT(*) AS fund_count FROM gold_fund
  GROUP BY strategy""")(lambda x: dash.aum_by_strategy(x.gold(GF)))
query("dash_property_financials", """SELECT property_name, property_type, fund_name, month, revenue, expenses, noi, occupancy_rate
  FROM gold_property""")(lambda x: dash.property_rows(x.gold(GP)))
query("dash_noi_trend", f"""SELECT month, {msum("revenue")} AS total_revenue, {msum("expenses")} AS total_expenses,
  {msum("noi")} AS total_noi FROM gold_property GROUP BY month""")(lambda x: dash.noi_trend(x.gold(GP)))
query("dash_gl_monthly", "SELECT fund_name, category, month, total_amount, transaction_count FROM gold_gl")(
    lambda x: dash.gl_monthly(x.gold(GG)))
query("dash_gl_by_category", f"""SELECT category, {msum("total_amount")} AS total_amount,
  CAST(SUM(transaction_count) AS BIGINT) AS total_transactions FROM gold_gl GROUP BY category""")(
    lambda x: dash.gl_by_category(x.gold(GG)))
query("dash_top_properties", f"""SELECT property_name, property_type, fund_name, {msum("revenue")} AS total_revenue,
  {msum("noi")} AS total_noi, {mavg("occupancy_rate")} AS avg_occupancy FROM gold_property GROUP BY ALL
  ORDER BY total_revenue DESC, property_name, property_type, fund_name LIMIT 15""")(lambda x: dash.top_properties(x.gold(GP)))
query("dash_spend_trend", f"SELECT month, category, {msum('total_amount')} AS total_amount FROM gold_gl GROUP BY ALL")(
    lambda x: dash.spend_trend(x.gold(GG)))
query("dash_volume_trend", "SELECT month, CAST(SUM(transaction_count) AS BIGINT) AS transaction_count FROM gold_gl GROUP BY month")(
    lambda x: dash.volume_trend(x.gold(GG)))

# ------------------------------------------------------------ questions
query("ask_total_aum", f"SELECT {msum('total_aum')} AS total_aum FROM gold_fund")(lambda x: dash.total_aum(x.gold(GF)))
query("ask_core_fund_count", "SELECT COUNT(*) AS fund_count FROM gold_fund WHERE strategy = 'core'")(
    lambda x: dash.fund_count(x.gold(GF), "core"))
query("ask_top3_revenue", f"""SELECT property_id, property_name, {msum("revenue")} AS total_revenue FROM gold_property GROUP BY ALL
  ORDER BY total_revenue DESC, property_id LIMIT 3""")(lambda x: dash.top_revenue(x.gold(GP)))
query("ask_opex_vs_capex", f"""SELECT category, {msum("total_amount")} AS total_amount FROM gold_gl
  WHERE category IN ('opex','capex') AND year(month) = 2000 GROUP BY category""")(
    lambda x: dash.category_spend(x.gold(GG), ["opex", "capex"], 2000))
query("ask_strategy_most_investors", """SELECT strategy, CAST(SUM(investor_count) AS BIGINT) AS investors FROM gold_fund
  GROUP BY strategy ORDER BY investors DESC, strategy LIMIT 1""")(lambda x: dash.strategy_most_investors(x.gold(GF)))
query("ask_avg_occupancy_by_type", f"""SELECT property_type, {rnd(mavg("occupancy_rate"), 6)} AS avg_occupancy, COUNT(*) AS property_count
  FROM silver_properties GROUP BY property_type""")(lambda x: dash.avg_occupancy(x.silver("properties")))
query("ask_monthly_revenue", f"""SELECT month, {msum("total_amount")} AS revenue FROM gold_gl
  WHERE category = 'revenue' AND year(month) = 2000 GROUP BY month""")(lambda x: dash.monthly_revenue(x.gold(GG), 2000))
query("ask_negative_noi_opportunistic", f"""SELECT property_id, property_name, noi FROM (
  SELECT property_id, property_name, CAST(SUM({c("revenue")} + {c("expenses")}) AS DOUBLE) / 100e0 AS noi
  FROM gold_property p WHERE fund_id IN (SELECT fund_id FROM silver_funds WHERE strategy = 'opportunistic')
  GROUP BY property_id, property_name) s WHERE noi < 0""")(
    lambda x: dash.negative_noi(x.gold(GP), x.silver("funds"), "opportunistic"))
query("ask_debt_service_share", f"""SELECT *, {rnd("debt_service / NULLIF(total_spend, 0) * 100", 4)} AS share_pct FROM (
  SELECT {mwhere("total_amount", "category = 'debt_service'")} AS debt_service, {msum("total_amount")} AS total_spend
  FROM gold_gl WHERE category IN ('opex','capex','debt_service')) s""")(lambda x: dash.debt_service_share(x.gold(GG)))
query("ask_portfolio_summary", f"""SELECT * FROM (SELECT {msum("total_aum")} AS total_aum, COUNT(*) AS fund_count,
  CAST(SUM(property_count) AS BIGINT) AS property_count, {msum("total_commitments")} AS total_commitments FROM gold_fund) f,
  (SELECT {msum("revenue")} AS total_revenue, {msum("noi")} AS total_noi FROM gold_property) p""")(
    lambda x: dash.portfolio_summary(x.gold(GF), x.gold(GP)))


# ------------------------------------------------------------ table functions
def looked_up(x, lookup, table, arguments):
    gold, view = x.gold(table), f"{lookup.name}_rows"
    gold.createOrReplaceTempView(view)
    lookup.create(gold, view)
    return x.spark.sql(f"SELECT * FROM {lookup.name}({arguments})")


query("tvf_fund_performance", """SELECT fund_name, strategy, total_aum, property_count, total_invested, current_portfolio_value,
  unrealized_gain_loss, investor_count FROM gold_fund WHERE strategy = 'core' AND total_aum >= 100000000""")(
    lambda x: looked_up(x, dash.FUND_LOOKUP, GF, "p_strategy => 'core', p_min_aum => 100000000D"))
query("tvf_property_financials", """SELECT property_name, property_type, fund_name, month, revenue, expenses, noi, occupancy_rate
  FROM gold_property WHERE property_type = 'large' AND month >= DATE '2000-06-01'""")(
    lambda x: looked_up(x, dash.PROPERTY_LOOKUP, GP, "p_type => 'large', p_start => DATE '2000-06-01'"))
query("tvf_gl_summary", """SELECT fund_name, category, month, total_amount, transaction_count, avg_transaction_amount
  FROM gold_gl WHERE category = 'capex' AND month >= DATE '2001-01-01'""")(
    lambda x: looked_up(x, dash.LEDGER_LOOKUP, GG, "p_category => 'capex', p_start => DATE '2001-01-01'"))
