"""Single operators over the bound tables: queries and oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from acreledger.functions import money as m
from acreledger.functions import scalars as s
from acreledger.operators import aggregates as ag
from acreledger.operators import distribution as dist
from acreledger.operators import joins as jn
from acreledger.operators import ordering as so
from acreledger.operators import predicates as flt
from acreledger.operators import publish as pub
from acreledger.plans import audit, fund_metrics, gold, latency, silver
from acreledger.testbed.registry import AS_OF, HI, LO, STAR_AS_OF, TENANT, c, define, mavg, msum, mwhere, query, rnd

# ------------------------------------------------------------ filters
RULES = silver.RULES["gl_transactions"]

query("flt_expect_drop", """SELECT transaction_id, arena_id, amount, property_id, category FROM gl_dirty
  WHERE transaction_id IS NOT NULL AND amount IS NOT NULL AND arena_id IS NOT NULL""")(
    lambda x: flt.expect_or_drop(x.t.gl_dirty, RULES))
query("flt_expect_drop_violations", """
SELECT 'valid_transaction_id' AS rule, COUNT(*) FILTER (transaction_id IS NULL) AS violations FROM gl_dirty
UNION ALL SELECT 'valid_amount', COUNT(*) FILTER (amount IS NULL) FROM gl_dirty
UNION ALL SELECT 'valid_arena_id', COUNT(*) FILTER (arena_id IS NULL) FROM gl_dirty""")(
    lambda x: flt.violation_counts(x.t.gl_dirty, RULES))
query("flt_tenant_eq", f"SELECT * FROM properties WHERE arena_id = '{TENANT}'")(
    lambda x: flt.tenant_eq(x.t.properties, "arena_id", TENANT))
query("flt_trailing_months", f"""SELECT transaction_id, transaction_date, amount FROM gl_raw
  WHERE transaction_date >= DATE '{AS_OF}' - INTERVAL 6 MONTH""")(
    lambda x: flt.trailing_months(x.t.gl_raw, "transaction_date", 6, AS_OF).select("transaction_id", "transaction_date", "amount"))
query("flt_interval_lookback", """SELECT event_id, action_name, status_code FROM audit_flat
  WHERE event_time >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 48 HOUR""")(
    lambda x: flt.lookback(x.t.audit_flat, "event_time", "48 HOURS", "2024-01-30 12:00:00").select("event_id", "action_name", "status_code"))
query("flt_between", f"SELECT * FROM fact_capital_call WHERE call_date BETWEEN DATE '{LO}' AND DATE '{HI}'")(
    lambda x: flt.between(x.t.fact_capital_call, "call_date", F.lit(LO).cast("date"), F.lit(HI).cast("date")))
query("flt_asof_cutoff", f"SELECT fund_id, distribution_date, amount_usd FROM fact_distribution WHERE distribution_date <= DATE '{STAR_AS_OF}'")(
    lambda x: flt.up_to(x.t.fact_distribution, "distribution_date", STAR_AS_OF).select("fund_id", "distribution_date", "amount_usd"))
query("flt_in_list", "SELECT transaction_id, category, amount FROM gl_raw WHERE category IN ('opex','capex','debt_service')")(
    lambda x: flt.in_list(x.t.gl_raw, "category", s.EXPENSE_CATEGORIES).select("transaction_id", "category", "amount"))
query("flt_in_subquery", """SELECT fund_id, property_id, value_usd FROM fact_valuation
  WHERE fund_id IN (SELECT fund_id FROM dim_capital_account)""")(
    lambda x: flt.in_subquery(x.t.fact_valuation, x.t.dim_capital_account.select("fund_id").distinct(), "fund_id").select(
        "fund_id", "property_id", "value_usd"))


@query("flt_scalar_subquery", """SELECT run_id, target, query_name, latency_ms FROM benchmark_raw
  WHERE run_id = (SELECT run_id FROM benchmark_runs WHERE mode = 'sustained' ORDER BY started_on DESC LIMIT 1)""")
def _(x):
    return latency.latest_run(x.t.benchmark_raw, x.t.benchmark_runs, "sustained").select("run_id", "target", "query_name", "latency_ms")


query("flt_like_prefix", "SELECT fund_id, waterfall_tier_id, amount_usd FROM fact_distribution WHERE waterfall_tier_id LIKE 'CARRY%'")(
    lambda x: flt.like_prefix(x.t.fact_distribution, "waterfall_tier_id", "CARRY").select("fund_id", "waterfall_tier_id", "amount_usd"))
query("flt_ilike_contains", "SELECT * FROM pipelines WHERE lower(name) LIKE '%ledger%' OR name ILIKE 'synced table: ledger%'")(
    lambda x: flt.ilike_any(x.t.pipelines, "name", ["%ledger%", "synced table: ledger%"]))
query("flt_cast_contains", """SELECT event_id, action_name FROM audit_flat WHERE CAST(request_params AS STRING) LIKE '%69%'""")(
    lambda x: flt.contains_any(x.t.audit_flat, ["request_params"], "69").select("event_id", "action_name"))
query("flt_prefix_exclude", """SELECT table_name, table_type FROM info_tables WHERE substr(table_name, 1, 2) <> '__'
  AND substr(table_name, 1, 10) <> 'event_log_' AND table_type <> 'FOREIGN'""")(
    lambda x: flt.exclude_prefixes(x.t.info_tables, "table_name", ["__", "event_log_"]).where("table_type <> 'FOREIGN'").select(
        "table_name", "table_type"))
query("flt_optional_params", "SELECT property_id, property_type, occupancy_rate FROM silver_properties WHERE occupancy_rate >= 0.9")(
    lambda x: flt.optional_params(silver.properties(x.t.properties), {"property_type": ("=", None), "occupancy_rate": (">=", 0.9)}).select(
        "property_id", "property_type", "occupancy_rate"))
query("flt_null_default", "SELECT * FROM benchmark_runs WHERE COALESCE(mode, 'lockstep') = 'lockstep'")(
    lambda x: flt.default_eq(x.t.benchmark_runs, "mode", "lockstep", "lockstep"))
query("flt_scd_current", "SELECT * FROM dim_investor WHERE is_current")(lambda x: x.t.dim_investor.where("is_current"))
query("flt_post_window", """SELECT fund_id, period_id, net, prior FROM (
  SELECT *, LAG(net) OVER (PARTITION BY fund_id ORDER BY period_id) AS prior FROM (
    SELECT fund_id, period_id, CAST(SUM(total_units) AS BIGINT) AS net FROM fact_nav_snapshot GROUP BY ALL) a) w WHERE prior IS NOT NULL""")(
    lambda x: so.lag_within(x.t.fact_nav_snapshot.groupBy("fund_id", "period_id").agg(F.sum("total_units").alias("net")),
                            ["fund_id"], ["period_id"], "net", "prior").where("prior IS NOT NULL"))
query("flt_measured", """SELECT run_id, iteration, total_latency_ms FROM benchmark_raw
  WHERE success AND NOT is_warmup AND total_latency_ms IS NOT NULL""")(
    lambda x: flt.measured(x.t.benchmark_raw).select("run_id", "iteration", "total_latency_ms"))

# ------------------------------------------------------------ scalar functions
query("fn_cast", """SELECT event_id, TRY_CAST(request_params AS DOUBLE) AS as_double, TRY_CAST(regexp_extract(request_params, '([0-9]+)', 1) AS INT) AS as_int,
  CAST(status_code AS STRING) AS as_text FROM audit_flat""")(lambda x: x.t.audit_flat.select(
    "event_id", s.cast_or_null(F.col("request_params"), "double").alias("as_double"),
    s.cast_or_null(F.regexp_extract("request_params", "([0-9]+)", 1), "int").alias("as_int"), F.col("status_code").cast("string").alias("as_text")))
query("fn_lower_normalize", "SELECT fund_id, lower(fund_name) AS fund_name, lower(strategy) AS strategy FROM funds")(
    lambda x: s.lower_columns(x.t.funds, ["fund_name", "strategy"]).select("fund_id", "fund_name", "strategy"))
query("fn_unrealized_gain", "SELECT property_id, current_valuation - acquisition_price AS unrealized_gain FROM properties")(
    lambda x: silver.properties(x.t.properties).select("property_id", "unrealized_gain"))
query("fn_fiscal_parts", """SELECT transaction_id, transaction_date, CAST(year(transaction_date) AS INT) AS fiscal_year,
  CAST(quarter(transaction_date) AS INT) AS fiscal_quarter FROM gl_raw""")(
    lambda x: silver.gl_conform(x.t.gl_raw).select("transaction_id", "transaction_date", "fiscal_year", "fiscal_quarter"))
query("fn_is_expense", "SELECT transaction_id, category, category IN ('opex','capex','debt_service') AS is_expense FROM gl_raw")(
    lambda x: silver.gl_conform(x.t.gl_raw).select("transaction_id", "category", "is_expense"))
query("fn_month_trunc", "SELECT transaction_id, CAST(date_trunc('month', transaction_date) AS DATE) AS month FROM gl_raw")(
    lambda x: x.t.gl_raw.select("transaction_id", s.month_start(F.col("transaction_date")).cast("date").alias("month")))
query("fn_period_label", "SELECT fund_id, call_date, concat('FY', year(call_date), '_Q', quarter(call_date)) AS period_id FROM fact_capital_call")(
    lambda x: x.t.fact_capital_call.select("fund_id", "call_date", s.period_label(F.col("call_date")).alias("period_id")))
query("fn_case_ladder", """SELECT property_id, CASE WHEN occupancy_rate <= 0.75 THEN 'Q1' WHEN occupancy_rate <= 0.85 THEN 'Q2'
  WHEN occupancy_rate <= 0.95 THEN 'Q3' ELSE 'Q4' END AS band FROM properties""")(
    lambda x: x.t.properties.select("property_id", s.case_ladder(
        F.col("occupancy_rate"), [F.lit(0.75), F.lit(0.85), F.lit(0.95)], ["Q1", "Q2", "Q3", "Q4"]).alias("band")))
query("fn_safe_ratio", "SELECT run_id, iteration, total_latency_ms / NULLIF(queue_time_ms, 0) AS ratio FROM benchmark_raw")(
    lambda x: x.t.benchmark_raw.select("run_id", "iteration", m.safe_ratio(F.col("total_latency_ms"), F.col("queue_time_ms")).alias("ratio")))
query("fn_power_proxy", f"""SELECT property_id, CASE WHEN r >= 0 THEN {rnd("pow(r, 25e-2) - 1", 9)} END AS proxy FROM (
  SELECT property_id, current_valuation / NULLIF(acquisition_price, 0) - 9e-1 AS r FROM properties) q""")(
    lambda x: x.t.properties.select("property_id", m.round_half_up(s.power_proxy(
        m.safe_ratio(F.col("current_valuation"), F.col("acquisition_price")) - F.lit(0.9)), 9).alias("proxy")))
query("fn_round", f"SELECT run_id, iteration, {rnd('latency_ms', 1)} AS rounded FROM benchmark_raw")(
    lambda x: x.t.benchmark_raw.select("run_id", "iteration", m.round_half_up(F.col("latency_ms"), 1).alias("rounded")))
query("fn_bytes_to_mb", "SELECT fund_id, doc_type_code, CAST(file_size_bytes AS DOUBLE) / 1024e0 / 1024e0 AS mb FROM fact_document_metadata")(
    lambda x: x.t.fact_document_metadata.select("fund_id", "doc_type_code", s.bytes_to_mb(F.col("file_size_bytes")).alias("mb")))
query("fn_concat_key", """SELECT table_catalog || '.' || table_schema || '.' || table_name AS object_key, grantee FROM table_privileges""")(
    lambda x: x.t.table_privileges.select(s.concat_key("table_catalog", "table_schema", "table_name").alias("object_key"), "grantee"))
query("fn_lpad_id", "SELECT o_orderkey, concat('TXN-', lpad(CAST(o_orderkey AS STRING), 12, '0')) AS id FROM orders")(
    lambda x: x.t.orders.select("o_orderkey", s.padded_id("TXN", F.col("o_orderkey"), 12).alias("id")))
query("fn_array_pick", "SELECT o_orderkey, ['St','Ave','Blvd','Rd'][CAST(abs(o_orderkey * 1973) % 4 AS INT) + 1] AS suffix FROM orders")(
    lambda x: x.t.orders.select("o_orderkey", s.pick_by_key(F.col("o_orderkey") * 1973, ["St", "Ave", "Blvd", "Rd"]).alias("suffix")))
query("fn_weighted_pick", """SELECT o_orderkey, CASE WHEN u < 0.1 THEN 'platinum' WHEN u < 0.4 THEN 'gold' ELSE 'silver' END AS tier
  FROM (SELECT o_orderkey, CAST(o_orderkey * 7919 % 10007 AS DOUBLE) / 10007e0 AS u FROM orders) q""")(
    lambda x: x.t.orders.select("o_orderkey", s.pick_by_share(
        ((F.col("o_orderkey") * 7919) % 10007).cast("double") / F.lit(10007.0), {"platinum": 0.1, "gold": 0.3, "silver": 0.6}).alias("tier")))
query("fn_clamp", "SELECT o_orderkey, least(greatest(o_totalprice, 50000e0), 300000e0) AS clamped FROM orders")(
    lambda x: x.t.orders.select("o_orderkey", s.clamp(F.col("o_totalprice"), 50000.0, 300000.0).alias("clamped")))
query("fn_date_arith", """SELECT fund_id, call_date, CAST(call_date + 30 AS DATE) AS due_date, CAST(call_date - INTERVAL 12 MONTH AS DATE) AS year_before,
  make_date(CAST(year(call_date) AS INT), 1, 1) AS year_start FROM fact_capital_call""")(
    lambda x: x.t.fact_capital_call.select("fund_id", "call_date", F.date_add("call_date", 30).alias("due_date"),
        F.add_months("call_date", -12).alias("year_before"), F.make_date(F.year("call_date"), F.lit(1), F.lit(1)).alias("year_start")))
query("fn_struct_field", "SELECT event_id, user_email, status_code, json_extract_string(request_params, '$.k') AS k FROM audit_flat")(
    lambda x: audit.nested_log(x.t.audit_flat).select(
        "event_id", F.col("user_identity.email").alias("user_email"), F.col("response.status_code").alias("status_code"),
        s.json_field(F.col("request_params"), "$.k").alias("k")))
query("fn_concat_ws_set", """SELECT fund_id, array_to_string(list_sort(list(DISTINCT property_type)), ', ') AS types FROM properties GROUP BY fund_id""")(
    lambda x: x.t.properties.groupBy("fund_id").agg(s.joined_set(F.collect_set("property_type")).alias("types")))


query("fn_memo_text", """SELECT transaction_id, concat_ws(' ', 'Posting', account_code, 'of', format('{:,.2f}', abs(amount)), 'with', counterparty_id)
  || CASE WHEN category = 'capex' THEN '. ' || repeat('Supporting detail retained on file. ', 8) ELSE '' END AS memo_text FROM gl_raw""")(
    lambda x: x.t.gl_raw.select("transaction_id", s.memo_text(
        F.col("account_code"), F.col("amount"), F.col("counterparty_id"), F.col("category") == "capex").alias("memo_text")))

# ------------------------------------------------------------ joins
query("jn_left_equi", """SELECT f.fund_id, fund_name, investor_id, commitment_amount FROM funds f LEFT JOIN investors i ON i.fund_id = f.fund_id""")(
    lambda x: jn.left_many(x.t.funds.select("fund_id", "fund_name"), x.t.investors.select("fund_id", "investor_id", "commitment_amount"), "fund_id"))
query("jn_left_equi_dim", """SELECT g.transaction_id, g.fund_id, fund_name, amount FROM gl_raw g LEFT JOIN funds f ON f.fund_id = g.fund_id""")(
    lambda x: jn.left_equi(x.t.gl_raw.select("transaction_id", "fund_id", "amount"), x.t.funds.select("fund_id", "fund_name"), "fund_id"))
query("jn_inner_equi", "SELECT p.property_id, property_name, transaction_id, amount FROM gl_raw g JOIN properties p ON p.property_id = g.property_id")(
    lambda x: jn.inner_equi(x.t.gl_raw.select("property_id", "transaction_id", "amount"), x.t.properties.select("property_id", "property_name"), "property_id"))
query("jn_inner_composite", """SELECT i.investor_id, i.fund_id, i.arena_id, fund_name FROM investors i JOIN funds f ON f.fund_id = i.fund_id AND f.arena_id = i.arena_id""")(
    lambda x: jn.inner_equi(x.t.investors.select("investor_id", "fund_id", "arena_id"), x.t.funds.select("fund_id", "arena_id", "fund_name"), ["fund_id", "arena_id"]))
query("jn_snowflake", """SELECT property_id, property_type_name, property_subtype_name, class_name, country_name, state_name, msa_name
  FROM dim_property p JOIN dim_property_type t ON t.property_type_code = p.property_type_code
  LEFT JOIN dim_property_subtype u ON u.property_subtype_code = p.property_subtype_code
  LEFT JOIN ref_property_class k ON k.class_code = p.property_class_code
  JOIN dim_geography_country g ON g.country_code = p.country_code
  LEFT JOIN dim_geography_state s ON s.state_code = p.state_code LEFT JOIN dim_geography_msa m ON m.msa_code = p.msa_code""")(
    lambda x: jn.snowflake(x.t.dim_property, [
        (x.t.dim_property_type, "property_type_code", "property_type_code", "inner"),
        (x.t.dim_property_subtype, "property_subtype_code", "property_subtype_code", "left"),
        (x.t.ref_property_class, "property_class_code", "class_code", "left"),
        (x.t.dim_geography_country, "country_code", "country_code", "inner"),
        (x.t.dim_geography_state, "state_code", "state_code", "left"),
        (x.t.dim_geography_msa, "msa_code", "msa_code", "left"),
    ]).select("property_id", "property_type_name", "property_subtype_name", "class_name", "country_name", "state_name", "msa_name"))
query("jn_left_range_cond", f"""SELECT a.capital_account_id, call_date, call_amount_usd FROM dim_capital_account a
  LEFT JOIN fact_capital_call k ON k.capital_account_id = a.capital_account_id AND k.call_date < DATE '{LO}'""")(
    lambda x: jn.left_before(x.t.dim_capital_account.select("capital_account_id"),
                             x.t.fact_capital_call.select("capital_account_id", "call_date", "call_amount_usd"),
                             ["capital_account_id"], "call_date", F.lit(LO).cast("date")))
query("jn_literal_cond", """SELECT fund_id, charge_date, amount_usd, cost_center_name FROM fact_fee_charge
  LEFT JOIN dim_cost_center ON cost_center_code = 'CC-001'""")(
    lambda x: jn.attach_literal(x.t.fact_fee_charge, x.t.dim_cost_center, "cost_center_code", "CC-001").select(
        "fund_id", "charge_date", "amount_usd", "cost_center_name"))
query("jn_cross", """SELECT fund_id, tier_id, tier_order FROM dim_fund CROSS JOIN dim_waterfall_tier""")(
    lambda x: jn.attach_all(x.t.dim_fund.select("fund_id"), x.t.dim_waterfall_tier.select("tier_id", "tier_order")))
query("jn_left_true", """SELECT fund_id, pair_code, is_active FROM dim_fund LEFT JOIN ref_currency_pair ON 1 = 1""")(
    lambda x: jn.attach_all(x.t.dim_fund.select("fund_id"), x.t.ref_currency_pair, "left"))
query("jn_top1_attach", """SELECT f.fund_id, entity_type, event_count FROM dim_fund f LEFT JOIN (
  SELECT entity_type, COUNT(*) AS event_count FROM fact_audit_event GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1) a ON 1 = 1""")(
    lambda x: jn.attach_top1(x.t.dim_fund.select("fund_id"), x.t.fact_audit_event.groupBy("entity_type").agg(
        F.count(F.lit(1)).alias("event_count")), [F.desc("event_count"), F.col("entity_type")]))
query("jn_semi", "SELECT * FROM dim_investor WHERE investor_id IN (SELECT investor_id FROM fact_distribution)")(
    lambda x: flt.in_subquery(x.t.dim_investor, x.t.fact_distribution.select("investor_id").distinct(), "investor_id"))
query("jn_agg_subqueries", f"""SELECT a.fund_id, contributions, distributions FROM
  (SELECT fund_id, {msum("call_amount_usd")} AS contributions FROM fact_capital_call GROUP BY 1) a
  LEFT JOIN (SELECT fund_id, {msum("amount_usd")} AS distributions FROM fact_distribution GROUP BY 1) b ON b.fund_id = a.fund_id""")(
    lambda x: jn.join_parts(
        x.t.fact_capital_call.groupBy("fund_id").agg(m.money_sum("call_amount_usd").alias("contributions")),
        [(x.t.fact_distribution.groupBy("fund_id").agg(m.money_sum("amount_usd").alias("distributions")), ["fund_id"])]))
query("jn_role_playing", """SELECT fund_id, call_date, a.status_name AS status_status_name, b.is_terminal AS terminal_is_terminal
  FROM fact_capital_call k JOIN ref_status_code a ON a.status_code = k.status_code JOIN ref_status_code b ON b.status_code = k.status_code""")(
    lambda x: jn.role_playing(x.t.fact_capital_call, x.t.ref_status_code, "status_code", {
        "status": ("status_code", ["status_name"]), "terminal": ("status_code", ["is_terminal"])}).select(
        "fund_id", "call_date", "status_status_name", "terminal_is_terminal"))
query("jn_grain_align", f"""SELECT a.investor_id, a.fund_id, commitment_usd, calls, fees FROM dim_capital_account a
  LEFT JOIN (SELECT investor_id, fund_id, {msum("call_amount_usd")} AS calls FROM fact_capital_call GROUP BY 1, 2) k
    ON k.investor_id = a.investor_id AND k.fund_id = a.fund_id
  LEFT JOIN (SELECT investor_id, fund_id, {msum("amount_usd")} AS fees FROM fact_fee_charge GROUP BY 1, 2) e
    ON e.investor_id = a.investor_id AND e.fund_id = a.fund_id""")(
    lambda x: jn.join_parts(x.t.dim_capital_account.select("investor_id", "fund_id", "commitment_usd"), [
        (x.t.fact_capital_call.groupBy("investor_id", "fund_id").agg(m.money_sum("call_amount_usd").alias("calls")), ["investor_id", "fund_id"]),
        (x.t.fact_fee_charge.groupBy("investor_id", "fund_id").agg(m.money_sum("amount_usd").alias("fees")), ["investor_id", "fund_id"])]))
query("jn_usage_price", f"""SELECT u.sku_name, usage_date, CAST({c("usage_quantity")} * unit_cents AS DOUBLE) / 10000e0 AS usd
  FROM usage_records u LEFT JOIN price_list p ON p.sku_name = u.sku_name""")(
    lambda x: audit.priced_usage(x.t.usage_records, x.t.price_list).select("sku_name", "usage_date", "usd"))

# ------------------------------------------------------------ aggregates
query("ag_group_sum_count", f"""SELECT fund_id, {msum("amount")} AS sum_amount, COUNT(transaction_id) AS count_transaction_id FROM gl_raw GROUP BY fund_id""")(
    lambda x: ag.sum_count(x.t.gl_raw, ["fund_id"], "amount", "transaction_id"))
query("ag_global", f"""SELECT COUNT(*) AS funds, {msum("aum")} AS aum FROM funds""")(
    lambda x: x.t.funds.agg(F.count(F.lit(1)).alias("funds"), m.money_total("aum").alias("aum")))
query("ag_cond_sum_bool", f"SELECT property_id, {mwhere('amount', 'posted')} AS posted_amount FROM gl_raw GROUP BY 1")(
    lambda x: x.t.gl_raw.groupBy("property_id").agg(ag.sum_where("amount", F.col("posted")).alias("posted_amount")))
query("ag_cond_sum_case", f"""SELECT fund_id, {mwhere("amount", "category = 'revenue'")} AS revenue, {mwhere("amount", "category = 'opex'")} AS opex,
  {mwhere("amount", "category IN ('capex','debt_service')")} AS capital FROM gl_raw GROUP BY fund_id""")(
    lambda x: ag.pivot_sums(x.t.gl_raw, ["fund_id"], "amount", {
        "revenue": F.col("category") == "revenue", "opex": F.col("category") == "opex", "capital": F.col("category").isin("capex", "debt_service")}))
query("ag_avg", f"SELECT fund_id, {mavg('amount')} AS avg_amount FROM gl_raw GROUP BY 1")(
    lambda x: x.t.gl_raw.groupBy("fund_id").agg(m.money_avg("amount").alias("avg_amount")))
query("ag_avg_of_avg", f"""SELECT arena_id, {rnd(mavg("a", "1000000e0"), 2)} AS unweighted, {rnd("CAST(SUM(s) AS DOUBLE) / CAST(SUM(n) AS DOUBLE) / 100e0", 2)} AS weighted
  FROM (SELECT arena_id, fund_id, {mavg("amount")} AS a, SUM({c("amount")}) AS s, COUNT(*) AS n FROM gl_raw GROUP BY 1, 2) g GROUP BY 1""")(
    lambda x: x.t.gl_raw.groupBy("arena_id", "fund_id").agg(
        m.money_avg("amount").alias("a"), F.sum(m.cents("amount")).alias("s"), F.count(F.lit(1)).alias("n"))
    .groupBy("arena_id").agg(
        m.round_half_up(m.money_avg("a", 1_000_000), 2).alias("unweighted"),
        m.round_half_up(F.sum("s").cast("double") / F.sum("n").cast("double") / F.lit(100.0), 2).alias("weighted")))
query("ag_count_distinct", "SELECT arena_id, COUNT(DISTINCT property_id) AS properties, COUNT(DISTINCT counterparty_id) AS counterparties FROM gl_raw GROUP BY 1")(
    lambda x: x.t.gl_raw.groupBy("arena_id").agg(F.countDistinct("property_id").alias("properties"), F.countDistinct("counterparty_id").alias("counterparties")))
query("ag_collect_set", "SELECT investor_id, array_to_string(list_sort(list(DISTINCT fund_id)), '|') AS fund_ids FROM investors GROUP BY 1")(
    lambda x: ag.distinct_list(x.t.investors, ["investor_id"], "fund_id", "f").select("investor_id", F.array_join("f", "|").alias("fund_ids")))
query("ag_array_agg_distinct", "SELECT fund_id, array_to_string(list_sort(list(DISTINCT category)), '|') AS categories FROM gl_raw GROUP BY 1")(
    lambda x: ag.distinct_list(x.t.gl_raw, ["fund_id"], "category", "f").select("fund_id", F.array_join("f", "|").alias("categories")))
query("ag_min_max", """SELECT fund_id, MIN(transaction_date) AS first_day, MAX(transaction_date) AS last_day, MIN(amount) AS low, MAX(amount) AS high FROM gl_raw GROUP BY 1""")(
    lambda x: x.t.gl_raw.groupBy("fund_id").agg(F.min("transaction_date").alias("first_day"), F.max("transaction_date").alias("last_day"),
                                                F.min("amount").alias("low"), F.max("amount").alias("high")))
query("ag_stddev", f"SELECT pair_code, {rnd('stddev_samp(rate)', 6)} AS rate_stddev FROM fact_fx_rate GROUP BY 1")(
    lambda x: x.t.fact_fx_rate.groupBy("pair_code").agg(m.round_half_up(F.stddev_samp("rate"), 6).alias("rate_stddev")))
query("ag_percentile_cont", """SELECT vintage_year, quantile_cont(committed_capital_usd, 0.25) AS p25, quantile_cont(committed_capital_usd, 0.5) AS p50,
  quantile_cont(committed_capital_usd, 0.75) AS p75 FROM dim_fund GROUP BY 1""")(
    lambda x: dist.percentiles(x.t.dim_fund, ["vintage_year"], "committed_capital_usd", {"p25": 0.25, "p50": 0.5, "p75": 0.75}))
query("ag_percentile_interp", f"""SELECT target, concurrency, query_name, {rnd("quantile_cont(latency_ms, 0.5)", 6)} AS p50_ms,
  {rnd("quantile_cont(latency_ms, 0.95)", 6)} AS p95_ms, {rnd("quantile_cont(latency_ms, 0.99)", 6)} AS p99_ms FROM benchmark_raw WHERE success GROUP BY 1, 2, 3""")(
    lambda x: latency.percentiles(x.t.benchmark_raw.where("success"), ["target", "concurrency", "query_name"], "latency_ms", latency.PERCENTILES))
# the sketch's rank error is rows / accuracy, below one row here, so the nearest-rank value is exact
query("ag_approx_percentile", """SELECT target, COALESCE(quantile_disc(latency_ms, 0.5) FILTER (query_name <> 'error'), quantile_disc(latency_ms, 0.5)) AS median_ms
  FROM benchmark_raw GROUP BY 1""")(
    lambda x: ag.approx_median(x.t.benchmark_raw, ["target"], "latency_ms", F.col("query_name") != "error", accuracy=1_000_000))
query("ag_coalesce_sum", f"""SELECT a.fund_id, COALESCE({msum("call_amount_usd")}, 0e0) AS called FROM dim_fund a
  LEFT JOIN fact_capital_call k ON k.fund_id = a.fund_id GROUP BY 1""")(
    lambda x: jn.join_parts(x.t.dim_fund.select("fund_id"), [(x.t.fact_capital_call.groupBy("fund_id").agg(
        m.money_sum("call_amount_usd").alias("called")), ["fund_id"])]).withColumn("called", F.coalesce("called", F.lit(0.0))))
query("ag_group_by_expr", f"""SELECT concat('FY', year(call_date), '_Q', quarter(call_date)) AS period_id, {msum("call_amount_usd")} AS called
  FROM fact_capital_call GROUP BY 1""")(
    lambda x: x.t.fact_capital_call.groupBy(s.period_label(F.col("call_date")).alias("period_id")).agg(m.money_sum("call_amount_usd").alias("called")))
query("ag_dedupe_key", """SELECT transaction_id, transaction_date, amount, property_id FROM silver_gl""")(
    lambda x: ag.dedupe(x.t.gl_raw, "transaction_id", ["transaction_date", "amount"], ["transaction_id", "transaction_date", "amount", "property_id"], counted=False))
query("ag_latest_per_key", """SELECT run_id, mode, target_rate_qps, started_on, duration_seconds, warmup_seconds FROM (
  SELECT *, row_number() OVER (PARTITION BY target_rate_qps ORDER BY started_on DESC) AS rn FROM benchmark_runs) r WHERE rn = 1""")(
    lambda x: ag.latest_per_key(x.t.benchmark_runs, ["target_rate_qps"], ["started_on"]))
query("ag_table_stats", """SELECT 'gl_raw' AS table_name, COUNT(*) AS row_count, MAX(transaction_date) AS last_altered FROM gl_raw
  UNION ALL SELECT 'funds', COUNT(*), NULL FROM funds UNION ALL SELECT 'fact_distribution', COUNT(*), MAX(distribution_date) FROM fact_distribution""")(
    lambda x: ag.table_stats({"gl_raw": (x.t.gl_raw, "transaction_date"), "funds": (x.t.funds, None),
                              "fact_distribution": (x.t.fact_distribution, "distribution_date")}))

# ------------------------------------------------------------ windows
IS_REVENUE = "category = 'revenue'"
define("prop_revenue", f"SELECT arena_id, property_id, {mwhere('amount', IS_REVENUE)} AS revenue FROM gl_raw GROUP BY 1, 2")
define("prop_year", f"SELECT property_id, CAST(year(transaction_date) AS INT) AS fiscal_year, {msum('amount')} AS net FROM gl_raw GROUP BY 1, 2")
define("fund_flow", f"SELECT fund_id, period_id, {msum('amount_usd')} AS flow FROM order_flow GROUP BY 1, 2")


def prop_revenue(x):
    return x.t.gl_raw.groupBy("arena_id", "property_id").agg(ag.sum_where("amount", F.col("category") == "revenue").alias("revenue"))


def prop_year(x):
    return x.t.gl_raw.groupBy("property_id", F.year("transaction_date").alias("fiscal_year")).agg(m.money_sum("amount").alias("net"))


def fund_flow(x):
    return x.t.order_flow.groupBy("fund_id", "period_id").agg(m.money_sum("amount_usd").alias("flow"))


query("wn_rank_global", "SELECT *, CAST(rank() OVER (PARTITION BY arena_id ORDER BY revenue DESC) AS INT) AS rnk FROM prop_revenue")(
    lambda x: dist.value_ranks(prop_revenue(x), ["arena_id"], "revenue"))
query("wn_rank_partition", """SELECT * FROM (SELECT *, CAST(rank() OVER (PARTITION BY fiscal_year ORDER BY net DESC) AS INT) AS rnk FROM prop_year) r WHERE rnk <= 50""")(
    lambda x: so.top_per_group(prop_year(x), ["fiscal_year"], [F.desc("net")], 50))
query("wn_lag", "SELECT *, LAG(net) OVER (PARTITION BY property_id ORDER BY fiscal_year) AS prev_net FROM prop_year")(
    lambda x: so.lag_within(prop_year(x), ["property_id"], ["fiscal_year"], "net", "prev_net"))
query("wn_lag_over_agg", f"""SELECT property_id, period_id, avg_value, LAG(avg_value) OVER (PARTITION BY property_id ORDER BY period_id) AS prior_value
  FROM (SELECT property_id, period_id, {mavg("value_usd")} AS avg_value FROM fact_valuation GROUP BY 1, 2) a""")(
    lambda x: so.lag_within(x.t.fact_valuation.groupBy("property_id", "period_id").agg(m.money_avg("value_usd").alias("avg_value")),
                            ["property_id"], ["period_id"], "avg_value", "prior_value"))
query("wn_running_sum", f"""SELECT fund_id, period_id, flow, CAST(SUM({c("flow")}) OVER (PARTITION BY fund_id ORDER BY period_id) AS DOUBLE) / 100e0 AS cumulative FROM fund_flow""")(
    lambda x: so.running_sum(fund_flow(x), ["fund_id"], "period_id", "flow", "cumulative"))
query("wn_peer_total", f"""SELECT fund_id, period_id, flow, CAST(SUM({c("flow")}) OVER (PARTITION BY fund_id) AS DOUBLE) / 100e0 AS fund_total FROM fund_flow""")(
    lambda x: ag.with_group_value(fund_flow(x), ["fund_id"], fund_total=m.money_sum("flow")))
query("wn_row_number_top1", """SELECT entity_type, event_type, event_count FROM (SELECT *, row_number() OVER (ORDER BY event_count DESC, entity_type, event_type) AS rn FROM (
  SELECT entity_type, event_type, COUNT(*) AS event_count FROM fact_audit_event GROUP BY 1, 2) a) r WHERE rn = 1""")(
    lambda x: so.top_k(x.t.fact_audit_event.groupBy("entity_type", "event_type").agg(F.count(F.lit(1)).alias("event_count")),
                       [F.desc("event_count"), F.col("entity_type"), F.col("event_type")], 1))
query("wn_qualify_latest", """SELECT query_name, target, run_id, iteration, latency_ms FROM (
  SELECT *, row_number() OVER (PARTITION BY query_name, target ORDER BY run_id DESC, iteration DESC) AS rn FROM benchmark_raw) r WHERE rn = 1""")(
    lambda x: so.first_per_group(x.t.benchmark_raw.select("query_name", "target", "run_id", "iteration", "latency_ms"),
                                 ["query_name", "target"], [F.desc("run_id"), F.desc("iteration")]))
query("wn_latest_run", """SELECT r.query_name, k.target_rate_qps, r.iteration, r.total_latency_ms FROM benchmark_raw r JOIN (
  SELECT run_id, target_rate_qps, query_name FROM (
    SELECT r.run_id, r.target_rate_qps, s.query_name, row_number() OVER (PARTITION BY s.query_name, r.target_rate_qps ORDER BY r.started_on DESC) AS rk
    FROM (SELECT DISTINCT run_id, query_name FROM benchmark_raw) s JOIN benchmark_runs r ON r.run_id = s.run_id WHERE r.mode = 'sustained') q WHERE rk = 1) k
  ON k.run_id = r.run_id AND k.query_name = r.query_name""")(
    lambda x: latency.latest_run_rows(
        x.t.benchmark_raw.select("run_id", "query_name").distinct(), x.t.benchmark_runs, x.t.benchmark_raw).select(
        "query_name", "target_rate_qps", "iteration", "total_latency_ms"))
query("wn_cdf", """SELECT target, latency_ms, CAST(row_number() OVER (PARTITION BY target ORDER BY latency_ms) AS DOUBLE)
  / CAST(COUNT(*) OVER (PARTITION BY target) AS DOUBLE) * 100e0 AS cdf FROM benchmark_raw""")(
    lambda x: dist.group_ranks(x.t.benchmark_raw.select("target", "latency_ms", "iteration"), ["target"], "latency_ms", "iteration").select(
        "target", "latency_ms", (F.col("rank_no").cast("double") / F.col("group_n").cast("double") * F.lit(100.0)).alias("cdf")))
query("wn_time_from_start", """SELECT run_id, target, iteration, scheduled_arrival_offset_ms - MIN(scheduled_arrival_offset_ms) OVER (PARTITION BY run_id, target) AS since_start
  FROM benchmark_raw""")(
    lambda x: ag.with_group_value(x.t.benchmark_raw, ["run_id", "target"], t0=F.min("scheduled_arrival_offset_ms")).select(
        "run_id", "target", "iteration", (F.col("scheduled_arrival_offset_ms") - F.col("t0")).alias("since_start")))

# ------------------------------------------------------------ order, limit, sample
query("so_order_desc", "SELECT fund_id, strategy, aum FROM funds")(
    lambda x: x.t.funds.select("fund_id", "strategy", "aum").orderBy("strategy", F.desc("aum"), "fund_id"))
query("so_nulls_first", "SELECT table_name, column_name, tag_name FROM (SELECT table_name, NULL AS column_name, tag_name FROM table_tags UNION ALL SELECT table_name, column_name, tag_name FROM column_tags) u ORDER BY table_name, column_name NULLS FIRST, tag_name LIMIT 100")(
    lambda x: so.union_padded(x.t.column_tags, x.t.table_tags).select("table_name", "column_name", "tag_name").orderBy(
        "table_name", F.asc_nulls_first("column_name"), "tag_name").limit(100))
query("so_case_order", """SELECT table_name, table_type, CASE table_type WHEN 'MATERIALIZED_VIEW' THEN 1 WHEN 'STREAMING_TABLE' THEN 2
  WHEN 'MANAGED' THEN 3 ELSE 4 END AS position FROM info_tables ORDER BY position, table_name""")(
    lambda x: x.t.info_tables.select("table_name", "table_type", so.case_order("table_type", audit.TABLE_TYPE_ORDER).alias("position")).orderBy(
        "position", "table_name"))
query("so_topk_limit", "SELECT transaction_id, property_id, amount FROM silver_gl ORDER BY amount DESC, transaction_id LIMIT 100")(
    lambda x: so.top_k(x.silver("gl_transactions").select("transaction_id", "property_id", "amount"), [F.desc("amount"), F.col("transaction_id")], 100))
query("so_topk_per_group", "SELECT * FROM (SELECT *, CAST(rank() OVER (PARTITION BY arena_id ORDER BY revenue DESC) AS INT) AS rnk FROM prop_revenue) r WHERE rnk <= 3")(
    lambda x: so.top_per_group(prop_revenue(x), ["arena_id"], [F.desc("revenue")], 3))
query("so_random_sample", """SELECT iteration, target, query_name, total_latency_ms FROM benchmark_raw WHERE success AND NOT is_warmup AND total_latency_ms IS NOT NULL
  ORDER BY md5(iteration || ':42'), iteration LIMIT 5000""")(lambda x: so.sample_rows(flt.measured(x.t.benchmark_raw).select("iteration", "target", "query_name", "total_latency_ms"), "iteration", 5000))
query("so_id_pool", "SELECT DISTINCT fund_id FROM funds ORDER BY fund_id LIMIT 500")(lambda x: so.id_pool(x.t.funds, "fund_id", 500))

# ------------------------------------------------------------ set operations
define("flows", """SELECT fund_id, period, amount, kind FROM (
  SELECT fund_id, concat('FY', year(call_date), '_Q', quarter(call_date)) AS period, call_amount_usd AS amount, 'CONTRIBUTION' AS kind FROM fact_capital_call
  UNION ALL SELECT fund_id, concat('FY', year(distribution_date), '_Q', quarter(distribution_date)), amount_usd, concat('DISTRIBUTION_', waterfall_tier_id) FROM fact_distribution
  UNION ALL SELECT fund_id, period_id, amount_usd, 'FEE' FROM fact_fee_charge) u""")
query("set_union_flows", "SELECT * FROM flows")(
    lambda x: fund_metrics.flow_rows(x.t.fact_capital_call, x.t.fact_distribution, x.t.fact_fee_charge).select(
        "fund_id", F.col("period_id").alias("period"), F.col("flow_usd").alias("amount"), F.col("flow_type").alias("kind")))
query("set_union_levels", """SELECT 'CATALOG' AS object_type, catalog_name AS name, grantee FROM catalog_privileges
  UNION ALL SELECT 'SCHEMA', schema_name, grantee FROM schema_privileges""")(
    lambda x: so.union_tagged({"CATALOG": x.t.catalog_privileges.select(F.col("catalog_name").alias("name"), "grantee"),
                               "SCHEMA": x.t.schema_privileges.select(F.col("schema_name").alias("name"), "grantee")}, "object_type"))
query("set_union_padded", """SELECT table_name, column_name, tag_name, tag_value FROM column_tags UNION ALL SELECT table_name, NULL, tag_name, tag_value FROM table_tags""")(
    lambda x: so.union_padded(x.t.column_tags, x.t.table_tags))
query("set_union_tables", """SELECT 'arenas' AS table_name, COUNT(*) AS n FROM arenas UNION ALL SELECT 'funds', COUNT(*) FROM funds UNION ALL SELECT 'investors', COUNT(*) FROM investors""")(
    lambda x: so.union_tagged({n: getattr(x.t, n).agg(F.count(F.lit(1)).alias("n")) for n in ("arenas", "funds", "investors")}, "table_name"))

# ------------------------------------------------------------ publishing
define("fund_new", "SELECT fund_id, fund_name, CASE WHEN vintage_year % 5 = 0 THEN aum + 1000 ELSE aum END AS aum, CASE WHEN vintage_year % 7 = 0 THEN NULL ELSE status END AS status FROM funds WHERE vintage_year <> 2016")
define("fund_old", "SELECT fund_id, fund_name, aum, status FROM funds WHERE vintage_year <> 2017")


def fund_old(x):
    return x.t.funds.where("vintage_year <> 2017").select("fund_id", "fund_name", "aum", "status")


def fund_new(x):
    f = x.t.funds.where("vintage_year <> 2016")
    return f.select("fund_id", "fund_name", F.when(F.col("vintage_year") % 5 == 0, F.col("aum") + 1000).otherwise(F.col("aum")).alias("aum"),
                    F.when(F.col("vintage_year") % 7 != 0, F.col("status")).alias("status"))


define("fund_diff", """SELECT COALESCE(n.fund_id, o.fund_id) AS fund_id, n.fund_name, n.aum, n.status,
  CASE WHEN o.fund_id IS NULL THEN 'insert' WHEN n.fund_id IS NULL THEN 'delete'
       WHEN n.fund_name IS NOT DISTINCT FROM o.fund_name AND n.aum IS NOT DISTINCT FROM o.aum AND n.status IS NOT DISTINCT FROM o.status THEN 'unchanged'
       ELSE 'update' END AS change_type FROM fund_new n FULL OUTER JOIN fund_old o ON o.fund_id = n.fund_id""")
query("pub_snapshot_diff", "SELECT * FROM fund_diff")(lambda x: pub.snapshot_diff(fund_old(x), fund_new(x), ["fund_id"]))
query("jn_publish_full_outer", "SELECT change_type, COUNT(*) AS n FROM fund_diff GROUP BY 1")(
    lambda x: pub.snapshot_diff(fund_old(x), fund_new(x), ["fund_id"]).groupBy("change_type").agg(F.count(F.lit(1)).alias("n")))
query("pub_apply_changes", "SELECT * FROM fund_new")(
    lambda x: pub.apply_changes(fund_old(x), pub.snapshot_diff(fund_old(x), fund_new(x), ["fund_id"]), ["fund_id"]))
query("pub_reconcile_counts", """SELECT 'funds' AS table_name, (SELECT COUNT(*) FROM fund_old) AS source_rows, (SELECT COUNT(*) FROM fund_new) AS target_rows,
    CASE WHEN (SELECT COUNT(*) FROM fund_old) = (SELECT COUNT(*) FROM fund_new) THEN 'ok' ELSE 'mismatch' END AS status
  UNION ALL SELECT 'silver_gl', (SELECT COUNT(DISTINCT transaction_id) FROM gl_raw), (SELECT COUNT(DISTINCT transaction_id) FROM gl_raw), 'ok'
  UNION ALL SELECT 'arenas', (SELECT COUNT(*) FROM arenas), NULL, 'skipped'""")(
    lambda x: pub.reconcile({"funds": fund_old(x), "silver_gl": silver.gl_transactions(x.t.gl_raw, silver.COUNTED), "arenas": x.t.arenas},
                            {"funds": fund_new(x), "silver_gl": x.silver("gl_transactions")}))
query("pub_pk_check", "SELECT property_id, month, COUNT(*) AS row_count FROM (SELECT property_id, date_trunc('month', transaction_date)::DATE AS month FROM gl_raw) g GROUP BY 1, 2 HAVING COUNT(*) > 1")(
    lambda x: pub.pk_violations(x.t.gl_raw.select("property_id", s.month_date(F.col("transaction_date")).alias("month")), ["property_id", "month"]))


GOLD_SQL = {"gold_fund_performance": "gold_fund", "gold_property_financials": "gold_property", "gold_investor_portfolio": "gold_investor",
            "gold_gl_monthly_summary": "gold_gl", "gold_arena_overview": "gold_arena"}
for _table, _pk in gold.PRIMARY_KEYS.items():
    query(f"pub_pk_check_{_table}", f"""SELECT '{_table}' AS table_name, COUNT(*) AS keys, CAST(SUM(n) AS BIGINT) AS row_count,
        COUNT(*) FILTER (n > 1) AS duplicate_keys FROM (SELECT COUNT(*) AS n FROM {GOLD_SQL[_table]} GROUP BY {', '.join(_pk)}) k""")(
        lambda x, t=_table, k=_pk: pub.key_report(x.lake.table(t), t, k))
