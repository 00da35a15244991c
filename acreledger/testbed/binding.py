"""Logical ledger tables expressed over the generic test tables.

Every entry is one SELECT whose text runs unchanged in Spark SQL and in the
oracle engine, so both sides start from the same rows.  Only the mapping is
shared; the operators under test are DataFrame code on the Spark side and
separate SQL on the oracle side.

House rules for the texts: `100e0` style literals are doubles in both engines,
money is built from integer cents, nothing depends on engine hashes.
"""

from __future__ import annotations

import re


def _id(prefix: str, key: str, width: int) -> str:
    """Zero-padded surrogate id; wider keys are kept whole, never cut."""
    text = f"CAST({key} AS STRING)"
    return f"concat('{prefix}-', lpad({text}, CAST(greatest({width}, length({text})) AS INT), '0'))"


ARENA = _id("ARN", "s_nationkey", 5)
FUND = _id("FND", "s_suppkey", 6)

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
]

BINDINGS: dict[str, str] = {}


def _bind(name: str, sql: str) -> None:
    BINDINGS[name] = sql.strip()


# ---------------------------------------------------------------- tenants
_bind("arenas", f"""
SELECT {_id("ARN", "n_nationkey", 5)} AS arena_id,
       n_name AS arena_name,
       CASE WHEN n_nationkey % 10 = 0 THEN 'platinum'
            WHEN n_nationkey % 10 <= 3 THEN 'gold' ELSE 'silver' END AS tier
FROM nation""")

_bind("funds", f"""
SELECT {FUND} AS fund_id, {ARENA} AS arena_id, s_name AS fund_name,
       CAST(2015 + s_suppkey % 11 AS INT) AS vintage_year,
       CASE s_suppkey % 4 WHEN 0 THEN 'Core' WHEN 1 THEN 'Value_Add'
            WHEN 2 THEN 'Opportunistic' ELSE 'Debt' END AS strategy,
       (1 + abs(s_acctbal)) * 100000 AS aum,
       CASE WHEN s_suppkey % 10 = 9 THEN 'closed' ELSE 'active' END AS status
FROM supplier""")

# part key -> owning fund key; the count is a one-row scalar
_bind("part_fund", """
SELECT p.*, p.p_partkey % (SELECT count(*) FROM supplier) AS fundkey FROM part p""")

_bind("properties", f"""
SELECT {_id("PRP", "p_partkey", 6)} AS property_id, {ARENA} AS arena_id,
       {FUND} AS fund_id, p_name AS property_name, p_brand AS address,
       CAST(lower(p_type) AS STRING) AS property_type,
       p_retailprice * 10000 AS acquisition_price,
       CAST(floor(p_retailprice * 10000 * (8e-1 + (p_partkey % 81) / 100e0) * 100e0 + 5e-1) AS BIGINT) / 100e0
         AS current_valuation,
       CAST(p_size * 1000 AS INT) AS square_footage,
       CAST(70 + p_partkey % 30 AS DOUBLE) / 100e0 AS occupancy_rate,
       CAST(DATE '1996-01-01' + CAST(p_partkey % 3650 AS INT) AS DATE) AS acquisition_date
FROM part_fund JOIN supplier ON s_suppkey = fundkey""")

# Funds of a nation, numbered from 0, and its number of funds.
_bind("nation_fund", """
SELECT s_nationkey, s_suppkey, s_name,
       row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS fund_slot
FROM supplier""")
_bind("nation_size", """
SELECT s_nationkey AS size_nationkey, count(*) AS n_open FROM supplier GROUP BY s_nationkey""")

# One to three commitments of a customer, dealt over all funds of the nation: one
# equi-join, and every fund has its turn.
_bind("customer_turn", """
SELECT *, 0 AS j FROM customer
UNION ALL SELECT *, 1 AS j FROM customer WHERE c_custkey % 3 >= 1
UNION ALL SELECT *, 2 AS j FROM customer WHERE c_custkey % 3 >= 2""")

_bind("commitments", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, s_suppkey, s_nationkey, j + 1 AS k,
       least(1 + c_custkey % 3, n_open) AS n_funds
FROM (SELECT customer_turn.*, n_open, (c_custkey + j) % n_open AS turn_slot
      FROM customer_turn JOIN nation_size ON c_nationkey = size_nationkey WHERE j < n_open) turns
JOIN nation_fund ON c_nationkey = s_nationkey AND turn_slot = fund_slot""")

_bind("investors", f"""
SELECT {_id("INV", "c_custkey", 7)} AS investor_id, {ARENA} AS arena_id,
       c_name AS investor_name, c_mktsegment AS type,
       (1 + abs(c_acctbal)) * 1000 AS commitment_amount, {FUND} AS fund_id,
       concat('City ', c_custkey % 30) AS city, concat('S', c_custkey % 50) AS state
FROM commitments""")

# ---------------------------------------------------------------- ledger
_bind("line_fund", """
SELECT l.*, l_partkey % (SELECT count(*) FROM supplier) AS fundkey,
       CASE WHEN l_returnflag = 'N' THEN 'revenue' WHEN l_returnflag = 'A' THEN 'opex'
            WHEN l_linestatus = 'F' THEN 'capex' ELSE 'debt_service' END AS category,
       CAST(floor(l_extendedprice * (1 - l_discount) * 100e0 + 5e-1) AS BIGINT) AS net_cents
FROM lineitem l""")

_GL_COLUMNS = f"""
  concat('TXN-', l_orderkey, '-', l_linenumber) AS transaction_id,
  {ARENA} AS arena_id, {_id("PRP", "l_partkey", 6)} AS property_id, {FUND} AS fund_id,
  CASE category
    WHEN 'revenue' THEN CASE l_linenumber % 3 WHEN 0 THEN '4100' WHEN 1 THEN '4200' ELSE '4300' END
    WHEN 'opex' THEN CASE l_linenumber % 5 WHEN 0 THEN '5100' WHEN 1 THEN '5200' WHEN 2 THEN '5300'
                     WHEN 3 THEN '5400' ELSE '5500' END
    WHEN 'capex' THEN CASE l_linenumber % 2 WHEN 0 THEN '6100' ELSE '6200' END
    ELSE CASE l_linenumber % 2 WHEN 0 THEN '7100' ELSE '7200' END END AS account_code,
  concat('line ', l_linenumber) AS description,
  (CASE WHEN category = 'revenue' THEN net_cents ELSE -net_cents END) / 100e0 AS amount,
  CAST(l_shipdate AS DATE) AS transaction_date, category,
  l_linenumber % 50 <> 0 AS posted"""

_bind("gl_raw", f"""
SELECT {_GL_COLUMNS},
  CASE WHEN l_suppkey % 20 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
  CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending' ELSE 'rejected' END
    AS approval_status,
  concat('CP-', o_custkey) AS counterparty_id
FROM line_fund
JOIN supplier ON s_suppkey = fundkey
JOIN orders ON o_orderkey = l_orderkey""")

# the same ledger with holes in its mandatory columns, for the row rules
_bind("gl_dirty", f"""
SELECT CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE transaction_id END AS transaction_id,
       CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE arena_id END AS arena_id,
       CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE amount END AS amount,
       property_id, category
FROM (SELECT l_partkey, {_GL_COLUMNS} FROM line_fund JOIN supplier ON s_suppkey = fundkey) g""")

# ---------------------------------------------------------------- finance star
_bind("dim_arena", f"""
SELECT {_id("ARN", "n_nationkey", 5)} AS arena_id, n_name AS arena_name, r_name AS region
FROM nation JOIN region ON n_regionkey = r_regionkey""")

_bind("dim_fund", f"""
SELECT {FUND} AS fund_id, {ARENA} AS arena_id, s_name AS fund_name,
  CASE s_suppkey % 3 WHEN 0 THEN 'CE' WHEN 1 THEN 'OE' ELSE 'EV' END AS fund_type_code,
  CAST(2015 + s_suppkey % 11 AS INT) AS vintage_year,
  concat('HS-', s_suppkey % 4) AS holding_strategy_code,
  concat('IS-', s_suppkey % 5) AS invest_strategy_code,
  CASE s_suppkey % 3 WHEN 0 THEN 'STD_80_20_8PREF' WHEN 1 THEN 'EUR_85_15_6PREF' ELSE 'NONE' END AS carry_code,
  concat('MF-', s_suppkey % 3) AS mgmt_fee_code,
  CASE s_suppkey % 5 WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' ELSE 'USD' END AS base_currency,
  (1 + abs(s_acctbal)) * 100000 AS committed_capital_usd,
  make_date(CAST(2015 + s_suppkey % 11 AS INT), 1, 1) AS inception_date,
  s_suppkey % 13 <> 12 AS is_current
FROM supplier""")

_bind("dim_investor", f"""
SELECT {_id("INV", "c_custkey", 7)} AS investor_id, {_id("ARN", "c_nationkey", 5)} AS arena_id,
  c_name AS investor_name, c_mktsegment AS investor_type_code,
  concat('ST-', c_custkey % 4) AS investor_subtype_code,
  CASE c_nationkey % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' WHEN 2 THEN 'DE' ELSE 'CA' END AS country_code,
  CASE c_custkey % 3 WHEN 0 THEN 'US_FED' WHEN 1 THEN 'UK_HMRC' ELSE 'OTHER' END AS tax_jurisdiction_code,
  c_custkey % 10 <> 0 AS is_accredited,
  DATE '1994-01-01' AS effective_from,
  c_custkey % 17 <> 16 AS is_current
FROM customer""")

_bind("dim_capital_account", f"""
SELECT concat('CA-', c_custkey, '-', s_suppkey) AS capital_account_id,
  {_id("INV", "c_custkey", 7)} AS investor_id, {FUND} AS fund_id,
  concat('TP-', c_custkey) AS tax_partner_id,
  (1 + abs(c_acctbal)) * 1000 AS commitment_usd
FROM commitments""")

_bind("dim_property", f"""
SELECT {_id("PRP", "p_partkey", 6)} AS property_id, {ARENA} AS arena_id, {FUND} AS fund_id,
  p_name AS property_name, p_type AS property_type_code,
  concat('PS-', p_partkey % 4) AS property_subtype_code,
  CASE p_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'X' END AS property_class_code,
  CASE p_partkey % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' WHEN 2 THEN 'DE' ELSE 'CA' END AS country_code,
  concat('S', p_partkey % 4) AS state_code, concat('MSA-', p_partkey % 5) AS msa_code,
  CAST(DATE '1996-01-01' + CAST(p_partkey % 3650 AS INT) AS DATE) AS acquisition_date,
  p_retailprice * 10000 AS acquisition_price_usd,
  CAST(p_size * 1000 AS INT) AS square_feet, CAST(p_size AS INT) AS units
FROM part_fund JOIN supplier ON s_suppkey = fundkey""")

_bind("dim_period", """
SELECT concat('FY', y, '_Q', q) AS period_id, concat('Q', q, ' ', y) AS period_label,
  make_date(y, CAST(3 * q - 2 AS INT), 1) AS period_start,
  CASE q WHEN 1 THEN make_date(y, 3, 31) WHEN 2 THEN make_date(y, 6, 30)
         WHEN 3 THEN make_date(y, 9, 30) ELSE make_date(y, 12, 31) END AS period_end,
  y AS fiscal_year, q AS fiscal_quarter, 'QUARTERLY' AS period_type_code
FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q
      FROM orders) quarters""")


def _values(name: str, columns: str, rows: str) -> None:
    _bind(name, f"SELECT * FROM (VALUES {rows}) AS v({columns})")


# Small reference tables (fixed rows).
_values("dim_fund_type", "fund_type_code, fund_type_name, is_closed_end",
        "('CE','Closed-end',true),('OE','Open-end',false),('EV','Evergreen',false)")
_values("dim_vintage_year", "vintage_year, market_cycle_phase, peer_cohort_size",
        ",".join(f"({y},'{p}',{n})" for y, p, n in
                 [(2015, 'expansion', 40), (2016, 'expansion', 42), (2017, 'late', 38),
                  (2018, 'late', 35), (2019, 'late', 30), (2020, 'trough', 18),
                  (2021, 'recovery', 25), (2022, 'recovery', 27), (2023, 'slow', 22),
                  (2024, 'slow', 20), (2025, 'recovery', 15)]))
_values("ref_holding_strategy", "strategy_code, strategy_name, risk_profile",
        "('HS-0','Core hold','low'),('HS-1','Core plus','medium'),('HS-2','Value add','high')")
_values("ref_investment_strategy", "invest_strategy_code, invest_strategy_name, typical_hold_years",
        "('IS-0','Income',10),('IS-1','Growth',7),('IS-2','Opportunity',5),('IS-3','Credit',4)")
_values("ref_carry_structure", "carry_code, pref_return_pct, gp_carry_pct, catchup_pct, waterfall_type",
        "('STD_80_20_8PREF',8e0,20e0,100e0,'american'),('EUR_85_15_6PREF',6e0,15e0,50e0,'european')")
_values("ref_mgmt_fee_schedule", "schedule_code, rate_pct, rate_basis",
        "('MF-0',15e-1,'committed'),('MF-1',125e-2,'invested')")
_values("dim_currency", "currency_code, currency_name, symbol",
        "('USD','US Dollar','$'),('EUR','Euro','E'),('GBP','Pound Sterling','L'),('CAD','Canadian Dollar','C')")
_values("dim_investor_type", "investor_type_code, investor_type_name",
        "('FURNITURE','Institutional'),('HOUSEHOLD','Family office'),('MACHINERY','Endowment'),"
        "('BUILDING','Pension'),('AUTOMOBILE','High net worth')")
_values("dim_investor_subtype", "investor_subtype_code, investor_subtype_name",
        "('ST-0','Public'),('ST-1','Private'),('ST-2','Sovereign')")
_values("dim_geography_country", "country_code, country_name, region",
        "('US','United States','Americas'),('GB','United Kingdom','Europe'),('DE','Germany','Europe'),"
        "('CA','Canada','Americas')")
_values("dim_geography_state", "state_code, state_name", "('S0','State 0'),('S1','State 1'),('S2','State 2')")
_values("dim_geography_msa", "msa_code, msa_name, population",
        "('MSA-0','Metro 0',1000000),('MSA-1','Metro 1',2000000),('MSA-2','Metro 2',500000),('MSA-3','Metro 3',750000)")
_values("dim_property_type", "property_type_code, property_type_name",
        "('MEDIUM','Multifamily'),('PROMO','Retail'),('STANDARD','Office'),('LARGE','Industrial'),"
        "('SMALL','Mixed use'),('ECONOMY','Storage')")
_values("dim_property_subtype", "property_subtype_code, property_subtype_name",
        "('PS-0','Garden'),('PS-1','Tower'),('PS-2','Park')")
_values("ref_property_class", "class_code, class_name, quality_rank",
        "('A','Class A',1),('B','Class B',2),('C','Class C',3)")
_values("dim_tax_jurisdiction", "tax_jurisdiction_code, jurisdiction_name, jurisdiction_level, withholding_rate",
        "('US_FED','US Federal','country',30e-2),('UK_HMRC','UK','country',20e-2)")
_values("dim_waterfall_tier", "tier_id, tier_name, tier_order, beneficiary",
        "('ROC','Return of capital',1,'LP'),('PREF','Preferred return',2,'LP'),('CATCHUP','GP catch-up',3,'GP'),"
        "('CARRY_T1','Carry tier 1',4,'GP'),('CARRY_T2','Carry tier 2',5,'GP')")
_values("ref_transaction_type", "transaction_type_code, transaction_type_name, category",
        "('CAPITAL_CALL','Capital call','CAPITAL'),('OPERATING','Operating entry','OPERATING'),"
        "('CAPEX','Capital expenditure','INVESTMENT'),('LOAN','Debt service','FINANCING')")
_values("ref_status_code", "status_code, status_name, is_terminal",
        "('F','Final',true),('O','Open',false),('P','Pending',false)")
_values("ref_approval_chain", "approval_tier_code, approval_tier_name", "('AP-0','Manager'),('AP-1','Director')")
_values("ref_account_type", "account_type_code, account_type_name, normal_balance",
        "('REVENUE','Revenue','credit'),('EXPENSE','Expense','debit'),('ASSET','Asset','debit')")
_values("dim_account_chart", "account_id, account_name, account_type_code",
        "('ACC-1','Rent','REVENUE'),('ACC-2','Parking','REVENUE'),('ACC-3','Other income','REVENUE'),"
        "('ACC-4','Maintenance','EXPENSE'),('ACC-5','Utilities','EXPENSE'),('ACC-6','Insurance','EXPENSE'),"
        "('ACC-7','Improvements','ASSET')")
_values("ref_distribution_method", "method_code, method_name", "('WIRE','Wire transfer'),('ACH','ACH transfer')")
_values("dim_employee_role", "role_code, role_name",
        "('ROLE-000','Accountant'),('ROLE-001','Controller'),('ROLE-002','Analyst'),('ROLE-003','Auditor'),"
        "('ROLE-005','Fee approver')")
_values("dim_cost_center", "cost_center_code, cost_center_name", "('CC-001','Fund operations'),('CC-002','Asset management')")
_values("ref_irs_k1_box", "k1_box_code, k1_box_name",
        "('1','Ordinary income'),('2','Rental income'),('3','Other rental'),('5','Interest'),"
        "('8','Short-term gain'),('9a','Long-term gain'),('11','Other income')")
_values("ref_fiscal_period_type", "period_type_code, period_type_name", "('QUARTERLY','Fiscal quarter'),('ANNUAL','Fiscal year')")
_values("ref_calendar_quarter", "quarter_num, quarter_label",
        "(1,'First quarter'),(2,'Second quarter'),(3,'Third quarter'),(4,'Fourth quarter')")
_values("ref_currency_pair", "pair_code, is_active", "('EURUSD',true),('GBPUSD',true),('CADUSD',false)")
_values("dim_document_type", "doc_type_code, doc_type_name",
        ",".join(f"('src{i}','Document class {i}')" for i in range(20)))

# each order is one investor cash flow into one of the investor's funds
_bind("order_flow", f"""
SELECT o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) AS flow_date, o_orderpriority,
  o_totalprice AS amount_usd,
  concat('FY', year(o_orderdate), '_Q', quarter(o_orderdate)) AS period_id,
  {_id("INV", "c_custkey", 7)} AS investor_id, {FUND} AS fund_id,
  concat('CA-', c_custkey, '-', s_suppkey) AS capital_account_id
FROM orders JOIN commitments ON o_custkey = c_custkey AND k = 1 + o_orderkey % n_funds""")

_bind("fact_capital_call", """
SELECT fund_id, investor_id, capital_account_id, flow_date AS call_date,
       amount_usd AS call_amount_usd, o_orderstatus AS status_code
FROM order_flow WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""")

_bind("fact_distribution", """
SELECT fund_id, investor_id, capital_account_id, flow_date AS distribution_date, amount_usd,
  CASE o_orderkey % 5 WHEN 0 THEN 'ROC' WHEN 1 THEN 'PREF' WHEN 2 THEN 'CATCHUP'
                      WHEN 3 THEN 'CARRY_T1' ELSE 'CARRY_T2' END AS waterfall_tier_id,
  CAST(floor(amount_usd * 10e0 + 5e-1) AS BIGINT) / 100e0 AS tax_withholding_usd,
  CASE o_orderkey % 2 WHEN 0 THEN 'WIRE' ELSE 'ACH' END AS distribution_method
FROM order_flow WHERE o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED')""")

_bind("fact_fee_charge", """
SELECT fund_id, investor_id, period_id, flow_date AS charge_date, amount_usd,
  CASE o_orderkey % 6 WHEN 0 THEN 'MGMT' WHEN 1 THEN 'PERF' WHEN 2 THEN 'ADMIN'
                      WHEN 3 THEN 'AUDIT' WHEN 4 THEN 'LEGAL' ELSE 'OTHER' END AS fee_type
FROM order_flow WHERE o_orderpriority = '5-LOW'""")

_bind("fact_allocation", f"""
SELECT fund_id, investor_id, {_id("PRP", "l_partkey", 6)} AS property_id,
  concat('ACC-', l_linenumber) AS account_id,
  concat('FY', year(l_shipdate), '_Q', quarter(l_shipdate)) AS period_id,
  CASE WHEN l_returnflag = 'N' THEN 'INCOME' WHEN l_returnflag = 'A' THEN 'EXPENSE'
       WHEN l_linestatus = 'F' THEN 'REALIZED_GAIN' ELSE 'UNREALIZED_GAIN' END AS allocation_type,
  CAST(floor(l_extendedprice * l_discount * 100e0 + 5e-1) AS BIGINT) / 100e0 AS allocated_amount_usd,
  l_discount AS allocation_pct, CAST(l_shipdate AS DATE) AS computed_at
FROM lineitem JOIN order_flow ON l_orderkey = o_orderkey""")

_bind("fact_valuation", f"""
SELECT {FUND} AS fund_id, {_id("PRP", "l_partkey", 6)} AS property_id,
  concat('FY', year(l_shipdate), '_Q', quarter(l_shipdate)) AS period_id,
  CAST(l_shipdate AS DATE) AS valuation_date,
  CASE l_returnflag WHEN 'N' THEN 'DCF' WHEN 'A' THEN 'COMPS' ELSE 'APPRAISAL' END AS valuation_method,
  l_extendedprice * 100 AS value_usd
FROM line_fund JOIN supplier ON s_suppkey = fundkey""")

_bind("fact_nav_snapshot", f"""
SELECT {FUND} AS fund_id,
  concat('FY', year(l_shipdate), '_Q', quarter(l_shipdate)) AS period_id,
  CAST(l_shipdate AS DATE) AS snapshot_date,
  CAST(floor(l_extendedprice * 100e0 + 5e-1) AS BIGINT) * 10e0 AS gross_nav_usd,
  CAST(floor(l_extendedprice * 1000 * (1 - l_tax) * 100e0 + 5e-1) AS BIGINT) / 100e0 AS net_nav_usd,
  l_extendedprice AS nav_per_unit, CAST(l_quantity AS BIGINT) AS total_units
FROM line_fund JOIN supplier ON s_suppkey = fundkey""")

_bind("fact_gl_transaction", f"""
SELECT {FUND} AS fund_id, concat('ACC-', l_linenumber) AS account_id,
  CASE category WHEN 'revenue' THEN 'CAPITAL_CALL' WHEN 'opex' THEN 'OPERATING'
                WHEN 'capex' THEN 'CAPEX' ELSE 'LOAN' END AS transaction_type_code,
  CASE WHEN l_suppkey % 20 = 0 THEN 'EUR' ELSE 'USD' END AS currency_code,
  o_orderstatus AS status_code, concat('AP-', l_partkey % 3) AS approval_chain_code,
  CAST(l_shipdate AS DATE) AS transaction_date,
  (CASE WHEN category = 'revenue' THEN net_cents ELSE -net_cents END) / 100e0 AS amount_usd
FROM line_fund
JOIN supplier ON s_suppkey = fundkey
JOIN orders ON o_orderkey = l_orderkey""")

_bind("fact_fx_rate", """
SELECT CASE user_id % 3 WHEN 0 THEN 'EURUSD' WHEN 1 THEN 'GBPUSD' ELSE 'CADUSD' END AS pair_code,
  CASE user_id % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' ELSE 'CAD' END AS base_currency,
  'USD' AS quote_currency,
  CAST(DATE '1995-01-01' + CAST(event_id % 2498 AS INT) AS DATE) AS rate_date,
  (50000 + CAST(floor(value * 100e0 + 5e-1) AS BIGINT)) / 100000e0 AS rate
FROM events""")

_bind("fact_audit_event", """
SELECT event_type AS entity_type,
  CASE user_id % 4 WHEN 0 THEN 'CREATE' WHEN 1 THEN 'UPDATE' WHEN 2 THEN 'APPROVE' ELSE 'DELETE' END AS event_type,
  concat('ROLE-00', user_id % 6) AS role_code, CAST(ts AS DATE) AS event_date, ts AS event_timestamp
FROM events""")

_bind("fact_document_metadata", f"""
SELECT {FUND} AS fund_id, source AS doc_type_code, n_chars AS file_size_bytes,
  CAST(1 + floor(n_chars / 3000e0) AS BIGINT) AS page_count
FROM (SELECT d.source, d.n_chars, d.doc_id % (SELECT count(*) FROM supplier) AS fundkey FROM documents d) x
JOIN supplier ON s_suppkey = fundkey""")

# ---------------------------------------------------------------- workload results
_bind("benchmark_raw", """
SELECT CAST(CAST(ts AS DATE) AS STRING) AS run_id,
  CASE user_id % 2 WHEN 0 THEN 'warehouse' ELSE 'postgres' END AS target,
  CAST(5 * (1 + user_id % 4) AS INT) AS concurrency, event_type AS query_name,
  event_id AS iteration, value AS latency_ms,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 25 <> 0 AS success,
  CAST((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) * 1000 AS DOUBLE) AS scheduled_arrival_offset_ms,
  CAST((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) * 1000 + user_id % 50 AS DOUBLE) AS actual_start_offset_ms,
  CAST(user_id % 50 AS DOUBLE) AS queue_time_ms,
  (CAST(floor(value * 100e0 + 5e-1) AS BIGINT) + 100 * (user_id % 50)) / 100e0 AS total_latency_ms,
  hour(ts) < 2 AS is_warmup
FROM events""")

_bind("benchmark_runs", """
SELECT CAST(d AS STRING) AS run_id, d AS started_on,
  CASE day(d) % 3 WHEN 0 THEN NULL WHEN 1 THEN 'lockstep' ELSE 'sustained' END AS mode,
  CAST(CASE day(d) % 4 WHEN 0 THEN 5 WHEN 1 THEN 10 WHEN 2 THEN 20 ELSE 1 END AS DOUBLE) AS target_rate_qps,
  86400 AS duration_seconds, 7200 AS warmup_seconds
FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events) days""")

# ---------------------------------------------------------------- audit, usage, catalog
_bind("audit_flat", """
SELECT event_id, ts AS event_time, concat('u', user_id, '@example.org') AS user_email,
  CASE user_id % 3 WHEN 0 THEN 'catalog' WHEN 1 THEN 'sql' ELSE 'accounts' END AS service_name,
  CASE event_type WHEN 'signup' THEN 'grantPermission' WHEN 'view' THEN 'login'
       WHEN 'click' THEN 'alterTable' WHEN 'purchase' THEN 'updatePermissions' ELSE 'tokenLogin' END AS action_name,
  concat('10.0.0.', user_id % 250) AS source_ip_address, props AS request_params,
  CASE WHEN event_type = 'error' AND user_id % 2 = 0 THEN 401 ELSE 200 END AS status_code
FROM events""")

_bind("usage_records", """
SELECT CAST(ts AS DATE) AS usage_date, event_type AS sku_name, value AS usage_quantity,
  concat('tier', user_id % 5) AS tier, concat('project', user_id % 3) AS project
FROM events""")
_values("price_list", "sku_name, unit_cents",
        "('signup',15),('view',22),('click',7),('purchase',55)")

_bind("info_tables", """
SELECT concat(CASE p_partkey % 5 WHEN 0 THEN '__' WHEN 1 THEN 'event_log_' WHEN 2 THEN 'silver_' ELSE 'gold_' END,
              'part_', p_partkey) AS table_name,
  CASE p_partkey % 4 WHEN 0 THEN 'MATERIALIZED_VIEW' WHEN 1 THEN 'STREAMING_TABLE'
                     WHEN 2 THEN 'MANAGED' ELSE 'FOREIGN' END AS table_type,
  p_brand AS table_owner, p_name AS comment,
  CAST(DATE '2020-01-01' + CAST(p_partkey % 700 AS INT) AS DATE) AS last_altered
FROM part""")
_bind("catalog_privileges", """
SELECT n_name AS catalog_name, 'owner' AS grantor, concat('grp', n_regionkey) AS grantee,
  'USE CATALOG' AS privilege_type FROM nation""")
_bind("schema_privileges", """
SELECT concat('NATION_', s_nationkey) AS catalog_name, concat('schema_', s_suppkey % 4) AS schema_name,
  'owner' AS grantor, concat('grp', s_suppkey) AS grantee, 'USE SCHEMA' AS privilege_type FROM supplier""")
_bind("table_privileges", """
SELECT concat('NATION_', c_nationkey) AS table_catalog, concat('schema_', c_custkey % 4) AS table_schema,
  lower(c_mktsegment) AS table_name, 'owner' AS grantor, concat('usr', c_custkey) AS grantee,
  CASE c_custkey % 2 WHEN 0 THEN 'SELECT' ELSE 'MODIFY' END AS privilege_type FROM customer""")
_bind("table_tags", """
SELECT concat('doc_', doc_id) AS table_name, 'quality' AS tag_name, CAST(quality AS STRING) AS tag_value FROM labels""")
_bind("column_tags", """
SELECT concat('doc_', doc_id) AS table_name, source AS column_name, 'lang' AS tag_name, lang AS tag_value FROM documents""")
_bind("pipelines", """
SELECT concat('pl-', page_id) AS pipeline_id,
  concat(CASE page_id % 3 WHEN 0 THEN 'Synced table: Ledger ' WHEN 1 THEN 'nightly LEDGER load ' ELSE 'other ' END, page_id) AS name,
  CAST(DATE '2024-01-01' + CAST(page_id % 365 AS INT) AS DATE) AS change_time,
  CASE WHEN page_id % 7 = 0 THEN DATE '2025-01-01' END AS delete_time
FROM pages""")


WORD = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")


def with_ctes(sql: str, defs: dict[str, str]) -> str:
    """Prefix ``sql`` with the definitions it names, dependencies first."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(WORD.findall(text)):
            if word in defs and word not in ordered:
                visit(defs[word])
                ordered.append(word)

    visit(sql)
    if not ordered:
        return sql
    ctes = ",\n".join(f"{name} AS ({defs[name]})" for name in ordered)
    return f"WITH {ctes}\n{sql}"
