"""Fund report and capital-account queries and oracles."""

from __future__ import annotations

from acreledger.plans import fund_metrics as fm
from acreledger.plans import pcap
from acreledger.testbed.registry import HI, LO, STAR_AS_OF, c, define, mavg, msum, mwhere, query, rnd

ENTITY_TYPES = ["signup", "purchase", "error", "view"]
ENTITY_SQL = "('signup','purchase','error','view')"


def star_query(name, sql=None):
    def register(fn):
        return query(name, sql)(lambda x: fn(x.t))

    return register


# ------------------------------------------------------------ dimensions
define("m_fund", """SELECT f.fund_id, f.arena_id, f.fund_name, f.fund_type_code, fund_type_name, is_closed_end, f.vintage_year, market_cycle_phase,
    peer_cohort_size, holding_strategy_code, hs.strategy_name AS holding_strategy_name, risk_profile, f.invest_strategy_code, invest_strategy_name,
    typical_hold_years, f.carry_code, pref_return_pct, gp_carry_pct, catchup_pct, waterfall_type, mgmt_fee_code, rate_pct AS mgmt_fee_rate,
    rate_basis AS mgmt_fee_basis, base_currency, currency_name, committed_capital_usd, inception_date, arena_name, a.region AS arena_region
  FROM dim_fund f JOIN dim_fund_type ft ON ft.fund_type_code = f.fund_type_code JOIN dim_vintage_year vy ON vy.vintage_year = f.vintage_year
  JOIN dim_arena a ON a.arena_id = f.arena_id LEFT JOIN ref_holding_strategy hs ON hs.strategy_code = holding_strategy_code
  LEFT JOIN ref_investment_strategy ist ON ist.invest_strategy_code = f.invest_strategy_code
  LEFT JOIN ref_carry_structure cs ON cs.carry_code = f.carry_code LEFT JOIN ref_mgmt_fee_schedule mf ON mf.schedule_code = mgmt_fee_code
  JOIN dim_currency cur ON cur.currency_code = base_currency WHERE f.is_current""")
define("m_property", """SELECT property_id, arena_id, property_name, p.property_type_code, property_type_name, p.property_subtype_code,
    property_subtype_name, property_class_code, class_name AS property_class_name, quality_rank, p.country_code,
    country_name AS property_country_name, g.region AS property_region, p.state_code, state_name, p.msa_code, msa_name,
    population AS msa_population, acquisition_date, acquisition_price_usd, square_feet, units
  FROM dim_property p JOIN dim_property_type t ON t.property_type_code = p.property_type_code
  LEFT JOIN dim_property_subtype u ON u.property_subtype_code = p.property_subtype_code
  LEFT JOIN ref_property_class k ON k.class_code = property_class_code JOIN dim_geography_country g ON g.country_code = p.country_code
  LEFT JOIN dim_geography_state s ON s.state_code = p.state_code LEFT JOIN dim_geography_msa m ON m.msa_code = p.msa_code""")
star_query("fund_metadata", "SELECT * FROM m_fund")(lambda s: fm.fund_metadata(s))
star_query("property_universe", "SELECT * FROM m_property")(lambda s: fm.property_universe(s))

# ------------------------------------------------------------ report pieces
define("m_flows", f"""SELECT fund_id, period_id, flow_type, {msum("usd")} AS flow_usd FROM (
    SELECT fund_id, concat('FY', year(call_date), '_Q', quarter(call_date)) AS period_id, 'CONTRIBUTION' AS flow_type, call_amount_usd AS usd
      FROM fact_capital_call WHERE call_date <= DATE '{STAR_AS_OF}'
    UNION ALL SELECT fund_id, concat('FY', year(distribution_date), '_Q', quarter(distribution_date)), concat('DISTRIBUTION_', waterfall_tier_id), amount_usd
      FROM fact_distribution WHERE distribution_date <= DATE '{STAR_AS_OF}'
    UNION ALL SELECT fund_id, period_id, 'FEE', amount_usd FROM fact_fee_charge WHERE charge_date <= DATE '{STAR_AS_OF}') u GROUP BY 1, 2, 3""")
define("m_cum", f"""SELECT *, CAST(SUM({c("contrib_usd")}) OVER w AS DOUBLE) / 100e0 AS cumulative_contrib_usd,
    CAST(SUM({c("dist_usd")}) OVER w AS DOUBLE) / 100e0 AS cumulative_dist_usd FROM (
  SELECT fund_id, period_id, {mwhere("flow_usd", "flow_type = 'CONTRIBUTION'")} AS contrib_usd,
    {mwhere("flow_usd", "flow_type LIKE 'DISTRIBUTION%'")} AS dist_usd, {mwhere("flow_usd", "flow_type = 'FEE'")} AS fee_usd
  FROM m_flows GROUP BY 1, 2) f WINDOW w AS (PARTITION BY fund_id ORDER BY period_id)""")
define("m_nav", f"""SELECT *, LAG(net_nav) OVER (PARTITION BY fund_id ORDER BY period_id) AS prior_net_nav FROM (
  SELECT fund_id, period_id, {mavg("gross_nav_usd")} AS gross_nav, {mavg("net_nav_usd")} AS net_nav, {mavg("nav_per_unit")} AS nav_per_unit,
    CAST(SUM(total_units) AS BIGINT) AS total_units FROM fact_nav_snapshot WHERE snapshot_date <= DATE '{STAR_AS_OF}' GROUP BY 1, 2) n""")
define("m_ratio", f"""SELECT *, CASE WHEN tvpi >= 0 THEN {rnd("pow(tvpi, 25e-2) - 1", 6)} END AS irr_proxy FROM (
  SELECT m.fund_id, m.period_id, cumulative_contrib_usd, cumulative_dist_usd, net_nav,
    cumulative_dist_usd / NULLIF(cumulative_contrib_usd, 0) AS dpi, (cumulative_dist_usd + net_nav) / NULLIF(cumulative_contrib_usd, 0) AS tvpi,
    net_nav / NULLIF(cumulative_contrib_usd, 0) AS rvpi
  FROM m_cum m LEFT JOIN m_nav n ON n.fund_id = m.fund_id AND n.period_id = m.period_id) r""")
define("m_attr", f"""SELECT fund_id, property_id, period_id, {msum("allocated_amount_usd")} AS property_pl_usd,
    {mwhere("allocated_amount_usd", "allocation_type = 'REALIZED_GAIN'")} AS realized_pl, {mwhere("allocated_amount_usd", "allocation_type = 'UNREALIZED_GAIN'")} AS unrealized_pl,
    {mwhere("allocated_amount_usd", "allocation_type = 'INCOME'")} AS income_pl, {mwhere("allocated_amount_usd", "allocation_type = 'EXPENSE'")} AS expense_pl
  FROM fact_allocation a JOIN dim_account_chart ac ON ac.account_id = a.account_id JOIN ref_account_type rat ON rat.account_type_code = ac.account_type_code
  WHERE computed_at <= DATE '{STAR_AS_OF}' GROUP BY 1, 2, 3""")
define("m_cohort", """SELECT vintage_year, COUNT(DISTINCT fund_id) AS cohort_size, quantile_cont(committed_capital_usd, 0.25) AS p25_committed,
    quantile_cont(committed_capital_usd, 0.5) AS p50_committed, quantile_cont(committed_capital_usd, 0.75) AS p75_committed
  FROM dim_fund WHERE is_current AND vintage_year IN (SELECT vintage_year FROM dim_vintage_year) GROUP BY 1""")
define("m_fx", f"""SELECT base_currency, quote_currency, is_active, {mavg("rate", "100000e0")} AS avg_rate, {rnd("stddev_samp(rate)", 6)} AS rate_stddev,
    MIN(rate) AS min_rate, MAX(rate) AS max_rate FROM fact_fx_rate f JOIN ref_currency_pair p ON p.pair_code = f.pair_code
  WHERE rate_date <= DATE '{STAR_AS_OF}' GROUP BY 1, 2, 3""")

GL_PARTS = ", ".join(
    f"{mwhere('amount_usd', cond)} AS {name}" for name, cond in {
        "revenue_usd": "rat.account_type_code = 'REVENUE'", "expense_usd": "rat.account_type_code = 'EXPENSE'",
        "noi_usd": "rat.account_type_code IN ('REVENUE','EXPENSE')", "capital_usd": "rtt.category = 'CAPITAL'",
        "operating_usd": "rtt.category = 'OPERATING'", "investment_usd": "rtt.category = 'INVESTMENT'",
        "financing_usd": "rtt.category = 'FINANCING'"}.items())


def gl_sql(where: str) -> str:
    return f"""SELECT gl.fund_id, gl.account_id, account_name, account_type_name, normal_balance, transaction_type_name, rtt.category,
    currency_name AS txn_currency, status_name AS txn_status, approval_tier_name, {msum("amount_usd")} AS total_gl_usd, {GL_PARTS}, COUNT(*) AS txn_count
  FROM fact_gl_transaction gl JOIN dim_account_chart ac ON ac.account_id = gl.account_id JOIN ref_account_type rat ON rat.account_type_code = ac.account_type_code
  JOIN ref_transaction_type rtt ON rtt.transaction_type_code = gl.transaction_type_code JOIN dim_currency cur ON cur.currency_code = gl.currency_code
  JOIN ref_status_code rs ON rs.status_code = gl.status_code LEFT JOIN ref_approval_chain rac ON rac.approval_tier_code = gl.approval_chain_code
  WHERE {where} GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9, 10"""


define("m_gl", gl_sql(f"transaction_date <= DATE '{STAR_AS_OF}'"))
define("m_audit", f"""SELECT entity_type, event_type, role_name, COUNT(*) AS event_count, MIN(event_timestamp) AS first_event, MAX(event_timestamp) AS last_event
  FROM fact_audit_event ae LEFT JOIN dim_employee_role er ON er.role_code = ae.role_code WHERE entity_type IN {ENTITY_SQL} GROUP BY 1, 2, 3""")


def history(s):
    return fm.cash_flow_history(s["fact_capital_call"], s["fact_distribution"], s["fact_fee_charge"], STAR_AS_OF)


star_query("fund_cash_flow_history", "SELECT * FROM m_flows")(history)
star_query("fund_cumulative_flows", "SELECT * FROM m_cum")(lambda s: fm.cumulative_flows(history(s)))
star_query("fund_nav_series", "SELECT * FROM m_nav")(lambda s: fm.nav_series(s["fact_nav_snapshot"], STAR_AS_OF))
star_query("property_valuation_history", f"""SELECT *, period_value_usd - prior_value_usd AS value_change_usd FROM (
  SELECT *, LAG(period_value_usd) OVER (PARTITION BY property_id ORDER BY period_id, valuation_method) AS prior_value_usd FROM (
    SELECT fund_id, property_id, period_id, valuation_method, {mavg("value_usd")} AS period_value_usd, MAX(valuation_date) AS latest_val_date
    FROM fact_valuation WHERE valuation_date <= DATE '{STAR_AS_OF}' GROUP BY 1, 2, 3, 4) v) w""")(
    lambda s: fm.valuation_history(s["fact_valuation"], STAR_AS_OF))
star_query("fund_metrics", "SELECT * FROM m_ratio")(
    lambda s: fm.ratios(fm.cumulative_flows(history(s)), fm.nav_series(s["fact_nav_snapshot"], STAR_AS_OF)))
star_query("property_attribution", "SELECT * FROM m_attr")(lambda s: fm.property_attribution(s, STAR_AS_OF))
QUARTILE = """CASE WHEN committed_capital_usd <= p25_committed THEN 'Q1' WHEN committed_capital_usd <= p50_committed THEN 'Q2'
  WHEN committed_capital_usd <= p75_committed THEN 'Q3' ELSE 'Q4' END AS peer_quartile"""
star_query("vintage_peer_quartiles", f"""SELECT f.fund_id, f.vintage_year, committed_capital_usd, cohort_size, p25_committed, p50_committed, p75_committed, {QUARTILE}
  FROM dim_fund f JOIN m_cohort k ON k.vintage_year = f.vintage_year WHERE is_current""")(fm.committed_capital_quartiles)
star_query("fx_period_stats", "SELECT * FROM m_fx")(lambda s: fm.fx_stats(s, hi=STAR_AS_OF))
star_query("gl_attribution", "SELECT * FROM m_gl")(lambda s: fm.gl_attribution(s, hi=STAR_AS_OF))
star_query("audit_summary", "SELECT * FROM m_audit")(lambda s: fm.audit_summary(s, ENTITY_TYPES))
star_query("document_summary", """SELECT fund_id, doc_type_name, COUNT(*) AS doc_count, CAST(SUM(file_size_bytes) AS DOUBLE) / 1024e0 / 1024e0 AS total_mb,
  CAST(SUM(page_count) AS BIGINT) AS total_pages FROM fact_document_metadata d JOIN dim_document_type t ON t.doc_type_code = d.doc_type_code GROUP BY 1, 2""")(
    fm.document_summary)

# ------------------------------------------------------------ the report
define("m_val", f"""SELECT *, period_value_usd - prior_value_usd AS value_change_usd FROM (
  SELECT *, LAG(period_value_usd) OVER (PARTITION BY property_id ORDER BY period_id) AS prior_value_usd FROM (
    SELECT fund_id, property_id, period_id, {mavg("value_usd")} AS period_value_usd FROM fact_valuation
    WHERE valuation_date <= DATE '{STAR_AS_OF}' GROUP BY 1, 2, 3) v) w""")
define("m_prop_period", """SELECT COALESCE(v.fund_id, a.fund_id) AS fund_id, COALESCE(v.property_id, a.property_id) AS property_id,
    COALESCE(v.period_id, a.period_id) AS period_id, period_value_usd, prior_value_usd, value_change_usd, property_pl_usd, realized_pl,
    unrealized_pl, income_pl, expense_pl
  FROM m_val v FULL OUTER JOIN m_attr a ON a.fund_id = v.fund_id AND a.property_id = v.property_id AND a.period_id = v.period_id""")
define("m_spine", """SELECT fund_id, period_id FROM m_cum UNION SELECT fund_id, period_id FROM m_nav""")
define("m_carried", f"""SELECT *, CAST(SUM({c("contrib_usd")}) OVER w AS DOUBLE) / 100e0 AS cumulative_contrib_usd,
    CAST(SUM({c("dist_usd")}) OVER w AS DOUBLE) / 100e0 AS cumulative_dist_usd FROM (
  SELECT s.fund_id, s.period_id, COALESCE(contrib_usd, 0e0) AS contrib_usd, COALESCE(dist_usd, 0e0) AS dist_usd, COALESCE(fee_usd, 0e0) AS fee_usd
  FROM m_spine s LEFT JOIN m_cum m ON m.fund_id = s.fund_id AND m.period_id = s.period_id) f WINDOW w AS (PARTITION BY fund_id ORDER BY period_id)""")
define("m_fund_period", f"""SELECT *, CASE WHEN tvpi >= 0 THEN {rnd("pow(tvpi, 25e-2) - 1", 6)} END AS irr_proxy FROM (
  SELECT m.*, gross_nav, net_nav, nav_per_unit, total_units, prior_net_nav, cumulative_dist_usd / NULLIF(cumulative_contrib_usd, 0) AS dpi,
    (cumulative_dist_usd + net_nav) / NULLIF(cumulative_contrib_usd, 0) AS tvpi, net_nav / NULLIF(cumulative_contrib_usd, 0) AS rvpi
  FROM m_carried m LEFT JOIN m_nav n ON n.fund_id = m.fund_id AND n.period_id = m.period_id) r""")


@star_query("q8_fund_rollup", f"""
SELECT x.fund_id, x.property_id, x.period_id, fund_name, fund_type_name, vintage_year, holding_strategy_name, waterfall_type, mgmt_fee_rate,
  committed_capital_usd, arena_name, arena_region, property_name, property_type_name, property_class_name, property_country_name, msa_name,
  contrib_usd, dist_usd, fee_usd, cumulative_contrib_usd, cumulative_dist_usd, period_value_usd, prior_value_usd, value_change_usd,
  gross_nav, net_nav, prior_net_nav, total_units, fx_avg_rate, fx_volatility, dpi, tvpi, rvpi, irr_proxy, property_pl_usd, realized_pl, unrealized_pl,
  income_pl, expense_pl, cohort_size, peer_quartile, total_gl_usd, gl_revenue, gl_expense, gl_noi, gl_txn_count, doc_count, doc_total_pages,
  audit_entity_type, audit_event_count
FROM m_prop_period x LEFT JOIN m_fund_period fp ON fp.fund_id = x.fund_id AND fp.period_id = x.period_id
JOIN (SELECT m.*, cohort_size, {QUARTILE}, fx.avg_rate AS fx_avg_rate, fx.rate_stddev AS fx_volatility, total_gl_usd, gl_revenue, gl_expense, gl_noi,
        gl_txn_count, doc_count, doc_total_pages, audit_entity_type, audit_event_count
  FROM m_fund m LEFT JOIN m_cohort k USING (vintage_year) LEFT JOIN m_fx fx ON fx.base_currency = m.base_currency AND quote_currency = 'USD'
  LEFT JOIN (SELECT fund_id, {msum("total_gl_usd")} AS total_gl_usd, {msum("revenue_usd")} AS gl_revenue, {msum("expense_usd")} AS gl_expense,
      {msum("noi_usd")} AS gl_noi, CAST(SUM(txn_count) AS BIGINT) AS gl_txn_count FROM m_gl GROUP BY 1) g ON g.fund_id = m.fund_id
  LEFT JOIN (SELECT fund_id, COUNT(*) AS doc_count, CAST(SUM(page_count) AS BIGINT) AS doc_total_pages FROM fact_document_metadata
      WHERE doc_type_code IN (SELECT doc_type_code FROM dim_document_type) GROUP BY 1) d ON d.fund_id = m.fund_id
  LEFT JOIN (SELECT entity_type AS audit_entity_type, event_count AS audit_event_count FROM m_audit
      ORDER BY event_count DESC, entity_type, event_type, role_name NULLS FIRST LIMIT 1) a ON 1 = 1) f ON f.fund_id = x.fund_id
LEFT JOIN (SELECT property_id, property_name, property_type_name, property_class_name, property_country_name, msa_name FROM m_property) p
  ON p.property_id = x.property_id""")
def _(s):
    return fm.fund_rollup(s, STAR_AS_OF, ENTITY_TYPES).select(*"""fund_id property_id period_id fund_name fund_type_name vintage_year
        holding_strategy_name waterfall_type mgmt_fee_rate committed_capital_usd arena_name arena_region property_name property_type_name
        property_class_name property_country_name msa_name contrib_usd dist_usd fee_usd cumulative_contrib_usd cumulative_dist_usd period_value_usd
        prior_value_usd value_change_usd gross_nav net_nav prior_net_nav total_units fx_avg_rate fx_volatility dpi tvpi rvpi irr_proxy property_pl_usd
        realized_pl unrealized_pl income_pl expense_pl cohort_size peer_quartile total_gl_usd gl_revenue gl_expense gl_noi gl_txn_count doc_count
        doc_total_pages audit_entity_type audit_event_count""".split())


# ------------------------------------------------------------ precomputed report
define("m_rates", f"""SELECT base_currency, period_id, p - o AS rate_delta FROM (
    SELECT base_currency, concat('FY', year(rate_date), '_Q', quarter(rate_date)) AS period_id, {mavg("rate", "100000e0")} AS p FROM fact_fx_rate WHERE quote_currency = 'USD' GROUP BY 1, 2) a
  JOIN (SELECT base_currency, {mavg("rate", "100000e0")} AS o FROM fact_fx_rate WHERE quote_currency = 'USD' GROUP BY 1) b USING (base_currency)""")
define("m_trail", f"""SELECT f.*, d.vintage_year, base_currency,
    (CAST(SUM({c("dist_usd")}) OVER w AS DOUBLE) / 100e0 + net_nav) / NULLIF(CAST(SUM({c("contrib_usd")}) OVER w AS DOUBLE) / 100e0, 0) AS last4
  FROM m_fund_period f JOIN dim_fund d ON d.fund_id = f.fund_id
  WINDOW w AS (PARTITION BY f.fund_id ORDER BY CAST(substr(f.period_id, 3, 4) AS INT) * 4 + CAST(substr(f.period_id, 9, 1) AS INT)
    RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)""")
define("m_peers", """SELECT vintage_year, period_id, quantile_cont(irr_proxy, 0.25) AS i25, quantile_cont(irr_proxy, 0.5) AS i50, quantile_cont(irr_proxy, 0.75) AS i75,
    quantile_cont(tvpi, 0.25) AS t25, quantile_cont(tvpi, 0.5) AS t50, quantile_cont(tvpi, 0.75) AS t75 FROM m_trail GROUP BY 1, 2""")


def _label(x: str, p: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= {p}25 THEN 'Q1' WHEN {x} <= {p}50 THEN 'Q2' WHEN {x} <= {p}75 THEN 'Q3' ELSE 'Q4' END"


define("g_attr", f"""SELECT x.fund_id, x.property_id, x.period_id, period_label, period_end, irr_proxy AS fund_irr_net,
    CASE WHEN last4 >= 0 THEN {rnd("pow(last4, 25e-2) - 1", 6)} END AS fund_irr_trailing_12m, tvpi AS moic_net, tvpi AS tvpi_net, dpi AS dpi_net, rvpi AS rvpi_net,
    {rnd("property_pl_usd / NULLIF(total_pl, 0)", 6)} AS property_contribution_pct, property_pl_usd AS property_attribution_usd,
    {_label("irr_proxy", "i")} AS peer_quartile_irr, {_label("tvpi", "t")} AS peer_quartile_moic, {rnd("i50", 6)} AS vintage_cohort_median_irr,
    value_change_usd AS gross_appreciation_usd,
    {rnd("CASE WHEN o.base_currency = 'USD' THEN 0e0 ELSE COALESCE(property_pl_usd * rate_delta, 0e0) END", 2)} AS fx_drag_usd, gross_nav, net_nav
  FROM (SELECT *, CAST(SUM({c("property_pl_usd")}) OVER (PARTITION BY fund_id, period_id) AS DOUBLE) / 100e0 AS total_pl FROM m_prop_period) x
  JOIN dim_fund o ON o.fund_id = x.fund_id
  LEFT JOIN m_trail f ON f.fund_id = x.fund_id AND f.period_id = x.period_id LEFT JOIN m_peers q ON q.vintage_year = f.vintage_year AND q.period_id = f.period_id
  LEFT JOIN dim_period d ON d.period_id = x.period_id LEFT JOIN m_rates r ON r.base_currency = o.base_currency AND r.period_id = x.period_id""")
star_query("gold_fund_attribution_period", "SELECT * FROM g_attr")(lambda s: fm.attribution_period(s, STAR_AS_OF))


@query("q8_refactored", f"""SELECT g.*, fund_name, vintage_year, fund_type_name, strategy_name AS holding_strategy_name, property_name, property_type_name, msa_code
FROM g_attr g JOIN dim_fund f ON f.fund_id = g.fund_id AND is_current JOIN dim_fund_type t ON t.fund_type_code = f.fund_type_code
LEFT JOIN ref_holding_strategy h ON h.strategy_code = f.holding_strategy_code JOIN dim_property p ON p.property_id = g.property_id
JOIN dim_property_type pt ON pt.property_type_code = p.property_type_code WHERE period_end <= DATE '{STAR_AS_OF}'""")
def _(x):
    return fm.attribution_report(x.gold("fund_attribution_period"), x.t, STAR_AS_OF)


# ------------------------------------------------------------ statement pieces
star_query("period_setup", f"""SELECT period_id, period_label, period_start, period_end, fiscal_year, fiscal_quarter, period_type_name, quarter_label
  FROM dim_period p JOIN ref_fiscal_period_type t ON t.period_type_code = p.period_type_code JOIN ref_calendar_quarter q ON q.quarter_num = fiscal_quarter
  WHERE period_start >= DATE '{LO}' AND period_end <= DATE '{HI}' AND p.period_type_code = 'QUARTERLY'""")(lambda s: pcap.period_setup(s, LO, HI))
define("p_investor", """SELECT investor_id, arena_id, investor_name, i.investor_type_code, investor_type_name, i.investor_subtype_code, investor_subtype_name,
    i.country_code, country_name, g.region AS investor_region, i.tax_jurisdiction_code, jurisdiction_name AS tax_jurisdiction_name, jurisdiction_level,
    withholding_rate, is_accredited, effective_from
  FROM dim_investor i JOIN dim_investor_type t ON t.investor_type_code = i.investor_type_code
  LEFT JOIN dim_investor_subtype u ON u.investor_subtype_code = i.investor_subtype_code JOIN dim_geography_country g ON g.country_code = i.country_code
  LEFT JOIN dim_tax_jurisdiction j ON j.tax_jurisdiction_code = i.tax_jurisdiction_code WHERE is_current""")
star_query("investor_profile", "SELECT * FROM p_investor")(lambda s: pcap.investor_profile(s))
star_query("fund_universe", "SELECT m.* EXCLUDE (arena_name, arena_region), symbol AS currency_symbol FROM m_fund m JOIN dim_currency k ON k.currency_code = base_currency")(
    pcap.fund_universe)
define("p_open", f"""SELECT *, CAST({c("commitment_usd")} + {c("prior_period_allocations")} + {c("prior_period_contributions")} - {c("prior_period_distributions")}
    - {c("prior_period_fees")} AS DOUBLE) / 100e0 AS opening_balance_usd FROM (
  SELECT ca.*, COALESCE(a, 0e0) AS prior_period_allocations, COALESCE(k, 0e0) AS prior_period_contributions, COALESCE(d, 0e0) AS prior_period_distributions,
    COALESCE(f, 0e0) AS prior_period_fees FROM dim_capital_account ca
  LEFT JOIN (SELECT investor_id, fund_id, {msum("allocated_amount_usd")} AS a FROM fact_allocation WHERE computed_at < DATE '{LO}' GROUP BY 1, 2) x USING (investor_id, fund_id)
  LEFT JOIN (SELECT investor_id, fund_id, {msum("amount_usd")} AS f FROM fact_fee_charge WHERE charge_date < DATE '{LO}' GROUP BY 1, 2) y USING (investor_id, fund_id)
  LEFT JOIN (SELECT capital_account_id, {msum("call_amount_usd")} AS k FROM fact_capital_call WHERE call_date < DATE '{LO}' GROUP BY 1) z USING (capital_account_id)
  LEFT JOIN (SELECT capital_account_id, {msum("amount_usd")} AS d FROM fact_distribution WHERE distribution_date < DATE '{LO}' GROUP BY 1) w USING (capital_account_id)) o""")
star_query("pcap_opening_balances", "SELECT * FROM p_open")(lambda s: pcap.opening_balances(s, LO))
star_query("pcap_contributions", f"""SELECT investor_id, fund_id, capital_account_id, {msum("call_amount_usd")} AS total_contributions_usd, COUNT(*) AS contribution_count,
  MIN(call_date) AS first_call_date, MAX(call_date) AS last_call_date, status_name, is_terminal FROM fact_capital_call k JOIN ref_status_code r ON r.status_code = k.status_code
  WHERE call_date BETWEEN DATE '{LO}' AND DATE '{HI}' GROUP BY investor_id, fund_id, capital_account_id, status_name, is_terminal""")(
    lambda s: pcap.contributions(s, LO, HI))
TIER_SUMS = ", ".join(f"{mwhere('amount_usd', cond)} AS dist_{n}_usd" for n, cond in {
    "roc": "waterfall_tier_id = 'ROC'", "pref": "waterfall_tier_id = 'PREF'", "catchup": "waterfall_tier_id = 'CATCHUP'",
    "carry": "waterfall_tier_id IN ('CARRY_T1','CARRY_T2')"}.items())
star_query("pcap_distributions", f"""SELECT investor_id, fund_id, capital_account_id, waterfall_tier_id, tier_name, tier_order, beneficiary, {TIER_SUMS},
  {msum("amount_usd")} AS total_distributions_usd, {msum("tax_withholding_usd")} AS total_withholding_usd, COUNT(*) AS distribution_count, method_name AS distribution_method_name
  FROM fact_distribution d JOIN dim_waterfall_tier w ON w.tier_id = waterfall_tier_id JOIN ref_distribution_method m ON m.method_code = distribution_method
  WHERE distribution_date BETWEEN DATE '{LO}' AND DATE '{HI}' GROUP BY investor_id, fund_id, capital_account_id, waterfall_tier_id, tier_name, tier_order, beneficiary, method_name""")(
    lambda s: pcap.distributions(s, LO, HI))
FEE_SUMS = ", ".join(f"""{mwhere("amount_usd", f"fee_type = '{t}'")} AS {t.lower()}_fee_usd""" for t in pcap.FEE_TYPES)
star_query("pcap_fees", f"""SELECT investor_id, fund_id, period_id, {FEE_SUMS}, {msum("amount_usd")} AS total_fees_usd, 'Fund operations' AS cost_center_name,
  'Fee approver' AS fee_approver_role FROM fact_fee_charge WHERE charge_date BETWEEN DATE '{LO}' AND DATE '{HI}' GROUP BY 1, 2, 3""")(lambda s: pcap.fees(s, LO, HI))
ALLOC = {"income_alloc_usd": "INCOME", "expense_alloc_usd": "EXPENSE", "realized_gain_usd": "REALIZED_GAIN", "unrealized_gain_usd": "UNREALIZED_GAIN"}
ALLOC_SUMS = ", ".join(f"""{mwhere('allocated_amount_usd', f"allocation_type = '{t}'")} AS {n}""" for n, t in ALLOC.items())
star_query("pcap_allocations", f"""SELECT investor_id, fund_id, period_id, allocation_type, account_type_name, normal_balance, {ALLOC_SUMS},
  {msum("allocated_amount_usd")} AS total_allocations_usd, {mavg("allocation_pct")} AS avg_allocation_pct
  FROM fact_allocation a JOIN dim_account_chart ac ON ac.account_id = a.account_id JOIN ref_account_type rat ON rat.account_type_code = ac.account_type_code
  WHERE computed_at BETWEEN DATE '{LO}' AND DATE '{HI}' GROUP BY 1, 2, 3, 4, 5, 6""")(lambda s: pcap.allocations(s, LO, HI))
star_query("pcap_valuations", f"""SELECT v.* EXCLUDE (first_day), property_name, property_type_name, property_subtype_name, property_class_name, msa_name, msa_population,
  state_name, property_country_name FROM (SELECT *, LAG(avg_value_usd) OVER (PARTITION BY property_id ORDER BY first_day, fund_id) AS prior_value_usd FROM (
    SELECT fund_id, property_id, {mavg("value_usd")} AS avg_value_usd, MAX(value_usd) AS max_value_usd, MIN(value_usd) AS min_value_usd, COUNT(*) AS valuation_count,
      MIN(valuation_date) AS first_day FROM fact_valuation WHERE valuation_date BETWEEN DATE '{LO}' AND DATE '{HI}'
      AND fund_id IN (SELECT fund_id FROM dim_capital_account) GROUP BY 1, 2) g) v JOIN m_property p ON p.property_id = v.property_id""")(
    lambda s: pcap.valuations(s, LO, HI))
star_query("pcap_gl_postings", gl_sql(f"transaction_date BETWEEN DATE '{LO}' AND DATE '{HI}' AND gl.fund_id IN (SELECT fund_id FROM dim_capital_account)"))(
    lambda s: fm.gl_attribution(s, LO, HI, funds=s["dim_capital_account"].select("fund_id").distinct()))
star_query("waterfall_terms", f"""SELECT tier_id, tier_name, tier_order, beneficiary, pref_return_pct, gp_carry_pct, catchup_pct, waterfall_type,
    COALESCE(paid_usd, 0e0) AS paid_usd, COALESCE(payments, 0) AS payments
  FROM dim_waterfall_tier CROSS JOIN ref_carry_structure s LEFT JOIN (
    SELECT waterfall_tier_id, {msum("amount_usd")} AS paid_usd, COUNT(*) AS payments FROM fact_distribution JOIN dim_fund USING (fund_id)
    WHERE carry_code = 'STD_80_20_8PREF' GROUP BY 1) d ON waterfall_tier_id = tier_id WHERE s.carry_code = 'STD_80_20_8PREF'""")(pcap.waterfall_terms)
star_query("tax_withholding_k1", f"""SELECT tax_jurisdiction_code, jurisdiction_name, jurisdiction_level, withholding_rate, k1_box_code, k1_box_name,
  {msum("tax_withholding_usd")} AS total_withholding_usd FROM dim_tax_jurisdiction CROSS JOIN ref_irs_k1_box CROSS JOIN fact_distribution
  WHERE tax_jurisdiction_code = 'US_FED' AND k1_box_code IN ('1','2','5','8','9a','11') AND distribution_date BETWEEN DATE '{LO}' AND DATE '{HI}' GROUP BY 1, 2, 3, 4, 5, 6""")(
    lambda s: pcap.tax_withholding(s, pcap.distributions(s, LO, HI)))
define("p_calls", f"""SELECT investor_id, fund_id, {msum("call_amount_usd")} AS total_contributions_usd, COUNT(*) AS contribution_count FROM fact_capital_call
  WHERE call_date BETWEEN DATE '{LO}' AND DATE '{HI}' GROUP BY 1, 2""")
define("p_dists", f"""SELECT investor_id, fund_id, {msum("amount_usd")} AS total_distributions_usd, {msum("tax_withholding_usd")} AS total_withholding_usd
  FROM fact_distribution WHERE distribution_date BETWEEN DATE '{LO}' AND DATE '{HI}' GROUP BY 1, 2""")
define("p_alloc", f"""SELECT investor_id, fund_id, {", ".join(f'''{mwhere("allocated_amount_usd", f"allocation_type = '{t}'")} AS {n}_usd''' for n, t in pcap.ALLOCATION_TYPES.items())},
    {msum("allocated_amount_usd")} AS total_allocations_usd FROM fact_allocation WHERE computed_at BETWEEN DATE '{LO}' AND DATE '{HI}' GROUP BY 1, 2""")
define("p_fees", f"""SELECT investor_id, fund_id, {msum("amount_usd")} AS total_fees_usd FROM fact_fee_charge WHERE charge_date BETWEEN DATE '{LO}' AND DATE '{HI}' GROUP BY 1, 2""")
define("p_metrics", f"""SELECT *, CAST(SUM({c("gain")}) OVER (PARTITION BY fund_id) AS DOUBLE) / 100e0 AS cumulative_pl_usd FROM (
  SELECT investor_id, fund_id, total_contributions_usd, total_distributions_usd, total_distributions_usd / NULLIF(total_contributions_usd, 0) AS period_dpi,
    gain / NULLIF(total_contributions_usd, 0) AS period_moic, (gain + total_distributions_usd) / NULLIF(total_contributions_usd, 0) AS period_tvpi, gain FROM (
    SELECT k.investor_id, k.fund_id, total_contributions_usd, total_distributions_usd, CAST({c("realized_usd")} + {c("unrealized_usd")} AS DOUBLE) / 100e0 AS gain
    FROM p_calls k JOIN p_dists USING (investor_id, fund_id) LEFT JOIN p_alloc USING (investor_id, fund_id)) a) b""")
star_query("pcap_period_metrics", "SELECT * EXCLUDE (gain) FROM p_metrics")(lambda s: pcap.period_metrics(s, LO, HI))


def z(x: str) -> str:
    return f"COALESCE({c(x)}, 0)"


@star_query("q8a_pcap_statement", f"""
SELECT o.investor_id, o.fund_id, p.period_id, investor_name, investor_type_name, country_name, withholding_rate, fund_name, vintage_year, waterfall_type,
  commitment_usd, opening_balance_usd, prior_period_contributions, prior_period_distributions, total_contributions_usd, contribution_count, total_distributions_usd,
  total_withholding_usd, total_fees_usd, income_usd, expense_usd, realized_usd, unrealized_usd, total_allocations_usd, period_dpi, period_moic, period_tvpi, cumulative_pl_usd,
  waterfall_tier_id, tier_name, beneficiary, tier_distributions_usd, tier_distribution_count, quarter_label,
  CAST({z("opening_balance_usd")} + {z("total_contributions_usd")} - {z("total_distributions_usd")} + {z("realized_usd")} + {z("unrealized_usd")} + {z("income_usd")}
    - {z("expense_usd")} - {z("total_fees_usd")} AS DOUBLE) / 100e0 AS computed_ending_balance_usd
FROM p_open o JOIN p_investor i ON i.investor_id = o.investor_id JOIN m_fund f ON f.fund_id = o.fund_id
CROSS JOIN (SELECT period_id, quarter_label FROM dim_period JOIN ref_calendar_quarter ON quarter_num = fiscal_quarter
  WHERE period_start >= DATE '{LO}' AND period_end <= DATE '{HI}') p
LEFT JOIN p_calls k ON k.investor_id = o.investor_id AND k.fund_id = o.fund_id
LEFT JOIN p_dists d ON d.investor_id = o.investor_id AND d.fund_id = o.fund_id
LEFT JOIN p_fees e ON e.investor_id = o.investor_id AND e.fund_id = o.fund_id
LEFT JOIN p_alloc a ON a.investor_id = o.investor_id AND a.fund_id = o.fund_id
LEFT JOIN (SELECT investor_id, fund_id, period_dpi, period_moic, period_tvpi, cumulative_pl_usd FROM p_metrics) m ON m.investor_id = o.investor_id AND m.fund_id = o.fund_id
LEFT JOIN (SELECT investor_id, fund_id, waterfall_tier_id, tier_name, beneficiary, {msum("amount_usd")} AS tier_distributions_usd, COUNT(*) AS tier_distribution_count
  FROM fact_distribution JOIN dim_waterfall_tier ON tier_id = waterfall_tier_id WHERE distribution_date BETWEEN DATE '{LO}' AND DATE '{HI}' GROUP BY 1, 2, 3, 4, 5) t
  ON t.investor_id = o.investor_id AND t.fund_id = o.fund_id""")
def _(s):
    return pcap.statement(s, LO, HI).select(*"""investor_id fund_id period_id investor_name investor_type_name country_name withholding_rate fund_name
        vintage_year waterfall_type commitment_usd opening_balance_usd prior_period_contributions prior_period_distributions total_contributions_usd contribution_count
        total_distributions_usd total_withholding_usd total_fees_usd income_usd expense_usd realized_usd unrealized_usd total_allocations_usd period_dpi period_moic
        period_tvpi cumulative_pl_usd waterfall_tier_id tier_name beneficiary tier_distributions_usd tier_distribution_count quarter_label
        computed_ending_balance_usd""".split())


# ------------------------------------------------------------ precomputed statement
def pid(d: str) -> str:
    return f"concat('FY', year({d}), '_Q', quarter({d}))"


define("g_events", f"""SELECT investor_id, fund_id, {pid("call_date")} AS period_id, 'CALL' AS kind, {c("call_amount_usd")} AS v FROM fact_capital_call
  UNION ALL SELECT investor_id, fund_id, {pid("distribution_date")}, waterfall_tier_id, {c("amount_usd")} FROM fact_distribution
  UNION ALL SELECT investor_id, fund_id, {pid("distribution_date")}, 'WITHHOLDING', {c("tax_withholding_usd")} FROM fact_distribution
  UNION ALL SELECT investor_id, fund_id, {pid("charge_date")}, 'FEE', {c("amount_usd")} FROM fact_fee_charge
  UNION ALL SELECT investor_id, fund_id, {pid("computed_at")}, allocation_type, {c("allocated_amount_usd")} FROM fact_allocation""")
TIERS = "('ROC','PREF','CATCHUP','CARRY_T1','CARRY_T2')"
KINDS = {"calls": "('CALL')", "fees": "('FEE')", "withheld": "('WITHHOLDING')", "dist": TIERS, "roc": "('ROC')", "pref": "('PREF')", "catchup": "('CATCHUP')",
         "carry": "('CARRY_T1','CARRY_T2')", "income": "('INCOME')", "expense": "('EXPENSE')", "realized": "('REALIZED_GAIN')", "unrealized": "('UNREALIZED_GAIN')"}
define("g_per", f"""SELECT investor_id, fund_id, period_id, {", ".join(f"CAST(SUM(CASE WHEN kind IN {k} THEN v ELSE 0 END) AS BIGINT) AS {n}" for n, k in KINDS.items())}
  FROM g_events GROUP BY 1, 2, 3""")
define("g_open", """SELECT p.*, commitment_usd, f.base_currency, rate_delta,
    COALESCE(SUM(calls - dist - fees + income - expense + realized + unrealized) OVER (PARTITION BY p.investor_id, p.fund_id ORDER BY p.period_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
  FROM g_per p JOIN dim_capital_account ca ON ca.investor_id = p.investor_id AND ca.fund_id = p.fund_id JOIN dim_fund f ON f.fund_id = p.fund_id
  LEFT JOIN m_rates r ON r.base_currency = f.base_currency AND r.period_id = p.period_id""")


def money(x: str) -> str:
    return f"CAST({x} AS DOUBLE) / 100e0"


define("g_pcap", f"""SELECT g.investor_id, g.fund_id, g.period_id, t.tier AS waterfall_tier_id, {money(f"{c('commitment_usd')} + prior")} AS opening_balance_usd,
    {money("calls")} AS contributions_usd, {", ".join(f"{money(n)} AS distributions_{n}" for n in ("roc", "pref", "catchup", "carry"))},
    {", ".join(f"{money(n)} AS allocations_{n}" for n in ("income", "expense", "realized", "unrealized"))}, {money("fees")} AS fees_total,
    {rnd(f"CASE WHEN base_currency = 'USD' THEN 0e0 ELSE COALESCE({money('income + expense + realized + unrealized')} * rate_delta, 0e0) END", 2)} AS fx_adjustment_usd,
    {money("withheld")} AS tax_withholding_usd,
    {money(f"{c('commitment_usd')} + prior + calls - dist + realized + unrealized + income - expense - fees")} AS closing_balance_usd,
    {money("dist")} / NULLIF({money("calls")}, 0) AS period_dpi, {money("realized + unrealized")} / NULLIF({money("calls")}, 0) AS period_moic,
    ({money("realized + unrealized")} + {money("dist")}) / NULLIF({money("calls")}, 0) AS period_tvpi
  FROM g_open g LEFT JOIN (SELECT DISTINCT investor_id, fund_id, period_id, kind AS tier FROM g_events WHERE kind IN {TIERS}) t
    ON t.investor_id = g.investor_id AND t.fund_id = g.fund_id AND t.period_id = g.period_id""")
star_query("gold_investor_pcap", "SELECT * FROM g_pcap")(pcap.investor_pcap)


@query("q8a_refactored", f"""SELECT g.*, period_label, investor_name, investor_type_name, fund_name, vintage_year, fund_type_name, tier_name AS waterfall_tier, tier_order
FROM g_pcap g JOIN dim_investor i ON i.investor_id = g.investor_id AND i.is_current JOIN dim_investor_type it ON it.investor_type_code = i.investor_type_code
JOIN dim_fund f ON f.fund_id = g.fund_id AND f.is_current JOIN dim_fund_type ft ON ft.fund_type_code = f.fund_type_code
JOIN dim_period p ON p.period_id = g.period_id LEFT JOIN dim_waterfall_tier w ON w.tier_id = g.waterfall_tier_id
WHERE period_start >= DATE '{LO}' AND period_end <= DATE '{HI}'""")
def _(x):
    return pcap.pcap_report(x.gold("investor_pcap"), x.t, LO, HI)
