"""Pipelines and reports on small frames, and invariants over the test tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from acreledger.functions.money import money_sum
from acreledger.plans import audit, fund_metrics, gold, integrity, latency, pcap, silver, workload
from acreledger.testbed.registry import HI, LO, STAR_AS_OF, Context

SF = "/root/testdata/sf0.001"
D = dt.date


@pytest.fixture(scope="module")
def ctx(spark):
    return Context(spark, SF)


def ledger(spark, rows):
    df = spark.createDataFrame(rows, "transaction_id string, arena_id string, property_id string, fund_id string, amount double, "
                                     "transaction_date date, category string, year int, month int")
    return silver.gl_transactions(df)


def dims(spark):
    props = spark.createDataFrame([("p1", "a1", "f1", "P1", "office", 0.9)], "property_id string, arena_id string, fund_id string, "
                                  "property_name string, property_type string, occupancy_rate double")
    funds = spark.createDataFrame([("f1", "a1", "F1")], "fund_id string, arena_id string, fund_name string")
    return props, funds


def test_property_financials_edges(spark):
    gl = ledger(spark, [
        ("t1", "a1", "p1", "f1", 100.0, D(2024, 1, 5), "revenue", 2024, 1), ("t2", "a1", "p1", "f1", -30.0, D(2024, 1, 9), "opex", 2024, 1),
        ("t3", "a1", "p1", "f1", 7.0, D(2024, 1, 9), None, 2024, 1),  # no category: neither revenue nor expense
        ("t4", "a2", "p1", "f1", 5.0, D(2024, 1, 9), "revenue", 2024, 1),  # same property under another tenant
        ("t5", "a1", "p9", "f1", 9.0, D(2024, 2, 9), "revenue", 2024, 2),  # property without a dimension row
        ("t5", "a1", "p9", "f1", 8.0, D(2024, 2, 9), "revenue", 2024, 2),  # duplicate key, larger amount loses
    ])
    got = {(r["arena_id"], r["property_id"]): r for r in gold.property_financials(*dims(spark), gl).collect()}
    assert (got["a1", "p1"]["revenue"], got["a1", "p1"]["expenses"], got["a1", "p1"]["noi"]) == (100.0, -30.0, 130.0)
    assert got["a2", "p1"]["noi"] == 5.0 and got["a1", "p9"]["property_name"] is None and got["a1", "p9"]["revenue"] == 8.0
    signed = gold.property_financials(*dims(spark), gl, expense_sign=-1).where("property_id = 'p1' AND arena_id = 'a1'").first()
    assert signed["noi"] == 70.0


def test_silver_drops_partition_columns_and_bad_rows(spark):
    gl = ledger(spark, [("t1", "a1", "p1", "f1", None, D(2024, 1, 5), "opex", 2024, 1), (None, "a1", "p1", "f1", 1.0, D(2024, 1, 5), "opex", 2024, 1),
                        ("t2", "a1", "p1", "f1", 1.0, D(2024, 5, 5), "capex", 2024, 5)])
    row = gl.collect()
    assert len(row) == 1 and row[0]["is_expense"] and (row[0]["fiscal_year"], row[0]["fiscal_quarter"]) == (2024, 2)
    assert "month" not in gl.columns


def test_unparseable_text_becomes_null(spark):
    raw = spark.createDataFrame([("f1", "a1", "Core", "12.5"), ("f2", "a1", "DEBT", "n/a")], "fund_id string, arena_id string, strategy string, aum string")
    assert sorted((r["strategy"], r["aum"]) for r in silver.funds(raw).collect()) == [("core", 12.5), ("debt", None)]


def test_yoy_zero_gap_and_single_year(spark):
    def row(i, prop, year, amount):
        return (f"t{i}", prop, "f1", year, amount, "revenue", "approved", "USD", f"c{i}")
    gl = spark.createDataFrame(
        [row(1, "zero", 2020, 0.0), row(2, "zero", 2021, 10.0), row(3, "gap", 2019, 10.0), row(4, "gap", 2021, 30.0), row(5, "one", 2021, 5.0)],
        "transaction_id string, property_id string, fund_id string, fiscal_year int, amount double, category string, approval_status string, "
        "currency string, counterparty_id string")
    props = spark.createDataFrame([(p,) for p in ("zero", "gap", "one")], "property_id string")
    funds = spark.createDataFrame([("f1",)], "fund_id string")
    got = workload.yoy_growth(gl, props, funds, 2022).collect()
    assert [(r["property_id"], r["yoy_growth"], r["rnk"]) for r in got] == [("gap", 2.0, 1)]


def test_top_properties_tie_at_the_cut(spark):
    df = spark.createDataFrame([("a", f"p{i:02d}", "n", "t", "f", D(2024, 1, 1), 10.0 if i >= 5 else 20.0, 1.0, 0.5) for i in range(12)],
                               "arena_id string, property_id string, property_name string, property_type string, fund_name string, month date, "
                               "revenue double, noi double, occupancy_rate double")
    got = workload.top_properties_by_revenue(df, "a", "2024-06-01").collect()
    assert len(got) == 10 and [r["property_id"] for r in got[5:]] == ["p05", "p06", "p07", "p08", "p09"]
    assert workload.top_properties_by_revenue(df, "none", "2024-06-01").count() == 0


def test_fund_ratios_without_contributions_or_nav(spark):
    cum = spark.createDataFrame([("f", "FY1_Q1", 0.0, 5.0), ("f", "FY1_Q2", 10.0, 5.0)],
                                "fund_id string, period_id string, cumulative_contrib_usd double, cumulative_dist_usd double")
    nav = spark.createDataFrame([("f", "FY1_Q1", 1.0)], "fund_id string, period_id string, net_nav double")
    a, b = fund_metrics.ratios(cum, nav).orderBy("period_id").collect()
    assert a["dpi"] is None and a["irr_proxy"] is None
    assert b["dpi"] == 0.5 and b["tvpi"] is None and b["irr_proxy"] is None


def test_ledger_is_conserved(ctx):
    gl = ctx.silver("gl_transactions")
    want = gl.agg(F.sum(F.round(F.col("amount") * 100).cast("long")), F.count("*")).first()
    got = ctx.gold("gl_monthly_summary").agg(F.sum(F.round(F.col("total_amount") * 100).cast("long")), F.sum("transaction_count")).first()
    assert tuple(want) == tuple(got)
    pnl = ctx.gold("property_financials").agg(F.sum(F.round((F.col("revenue") + F.col("expenses")) * 100).cast("long"))).first()[0]
    assert pnl == want[0]


def test_statement_equals_precomputed_statement(ctx):
    s = ctx.t
    full = pcap.statement(s, LO, HI).where("waterfall_tier_id IS NOT NULL").select(
        "investor_id", "fund_id", "waterfall_tier_id", "opening_balance_usd", F.col("total_contributions_usd").alias("c"),
        F.col("computed_ending_balance_usd").alias("e"))
    short = pcap.pcap_report(pcap.investor_pcap(s), s, LO, HI).select(
        "investor_id", "fund_id", "waterfall_tier_id", F.col("opening_balance_usd").alias("o2"), F.col("contributions_usd").alias("c2"),
        F.col("closing_balance_usd").alias("e2"))
    # the statement's opening balance adds earlier expense as booked; the precomputed one rolls forward and subtracts it
    earlier = s["fact_allocation"].where((F.col("computed_at") < LO) & (F.col("allocation_type") == "EXPENSE")).groupBy("investor_id", "fund_id").agg(
        money_sum("allocated_amount_usd").alias("expense"))
    both = full.join(short, ["investor_id", "fund_id", "waterfall_tier_id"]).join(earlier, ["investor_id", "fund_id"], "left").collect()
    assert len(both) == full.count() > 0
    for r in both:
        twice = 2 * (r["expense"] or 0.0)
        assert (r["opening_balance_usd"], r["c"] or 0.0, r["e"]) == pytest.approx((r["o2"] + twice, r["c2"], r["e2"] + twice), abs=0.005)


def test_statement_rows_are_unique(ctx):
    rows = pcap.statement(ctx.t, LO, HI)
    assert rows.groupBy("investor_id", "fund_id", "period_id", "waterfall_tier_id").count().where("count > 1").count() == 0


def test_rollup_agrees_with_its_precomputed_form(ctx):
    s = ctx.t
    key = ["fund_id", "property_id", "period_id"]
    full = fund_metrics.fund_rollup(s, STAR_AS_OF, ["signup"]).select(*key, "dpi", "tvpi", "property_pl_usd")
    assert full.groupBy(*key).count().where("count > 1").count() == 0
    short = fund_metrics.attribution_period(s, STAR_AS_OF).select(*key, F.col("dpi_net").alias("d2"), F.col("tvpi_net").alias("t2"),
                                                                  F.col("property_attribution_usd").alias("p2"))
    joined = full.join(short, key)
    assert joined.count() > 0
    assert joined.where("NOT (dpi <=> d2 AND tvpi <=> t2 AND property_pl_usd <=> p2)").count() == 0


RAW = ("run_id string, target string, concurrency int, query_name string, iteration long, latency_ms double, success boolean, "
       "actual_start_offset_ms double, total_latency_ms double, is_warmup boolean")


def sample(i, q, ms, ok=True, offset=0.0, warm=False):
    return ("r1", "wh", 4, q, i, ms, ok, offset, ms, warm)


def test_lockstep_summary(spark):
    raw = spark.createDataFrame([sample(i, "q", float(v)) for i, v in enumerate([100, 200, 300, 400, 500, 600, 700, 1000])]
                                + [sample(9, "bad", -1.0, False), sample(10, "one", 50.0), sample(11, "one", -1.0, False)], RAW)
    got = {r["query_name"]: r for r in latency.summary_lockstep(raw).collect()}
    assert set(got) == {"q", "one"}  # a query without a success has no summary
    assert got["q"]["p50_ms"] == 450.0 and got["q"]["throughput_qps"] == 8 / 2.0  # two rounds of at most one second
    assert (got["one"]["p95_ms"], got["one"]["error_rate"], got["one"]["failed"]) == (50.0, 0.5, 1)


def test_timeseries_buckets(spark):
    raw = spark.createDataFrame([sample(1, "q", 10.0, offset=0.0), sample(2, "q", 30.0, offset=29_999.0), sample(3, "q", 5.0, offset=30_000.0),
                                 sample(4, "q", -1.0, False, offset=65_000.0), sample(5, "q", 7.0, offset=95_000.0)], RAW)
    got = sorted((r["bucket_start_offset_s"], r["bucket_end_offset_s"], r["p50_ms"], r["achieved_qps"], r["is_warmup"])
                 for r in latency.timeseries(raw, 30, 30, 100).collect())
    assert got == [(0, 30, 20.0, 2 / 30, True), (30, 60, 5.0, 1 / 30, False), (90, 100, 7.0, 1 / 30, False)]


def test_headline_falls_back_to_the_worst_query(spark):
    summary = spark.createDataFrame([("r1", "wh", "worst", 900.0, 950.0, 3, 0), ("r2", "wh", "worst", 900.0, 950.0, 3, 0), ("r2", "wh", "a", 10.0, 11.0, 5, 1)],
                                    "run_id string, target string, query_name string, p95_ms double, p99_ms double, successful long, failed long")
    runs = spark.createDataFrame([("r1", D(2024, 1, 1), "sustained", 5.0), ("r2", D(2024, 1, 2), "sustained", 5.0), ("r3", D(2024, 1, 3), "sustained", 5.0)],
                                 "run_id string, started_on date, mode string, target_rate_qps double")
    got = {r["run_id"]: r for r in latency.headline(summary, runs, "worst").collect()}
    assert got["r1"]["p95_median_ms"] == 900.0 and got["r2"]["p95_median_ms"] == 10.0 and got["r3"]["target"] is None
    assert got["r2"]["p95_max_ms"] == 900.0 and got["r2"]["total_failures"] == 1


def test_speedup_marks_unfinished(spark):
    df = spark.createDataFrame([("a", "shape", 8e6), ("a", "short", 100.0), ("b", "shape", 500.0), ("b", "short", 100.0), ("c", "short", 1.0)],
                               "target string, query_name string, p95_ms double")
    got = {r["target"]: (r["speedup"], r["outcome"]) for r in latency.speedup(df, "shape", "short").collect()}
    assert got == {"a": (None, "DNF"), "b": (5.0, "ok"), "c": (None, "pending")}


def test_failed_logins_bounds(spark):
    flat = spark.createDataFrame([(i, dt.datetime(2024, 1, d), "u", "s", a, "ip", "{}", c) for i, (d, a, c) in enumerate(
        [(30, "login", 401), (30, "login", 500), (30, "other", 401), (20, "login", 499), (25, "tokenLogin", 400)])],
        "event_id int, event_time timestamp_ntz, user_email string, service_name string, action_name string, source_ip_address string, "
        "request_params string, status_code int")
    got = audit.failed_logins(audit.nested_log(flat), "2024-01-30 00:00:00")
    assert sorted(r["event_id"] for r in got.collect()) == [0, 4]


def test_integrity_report_counts_orphans(spark):
    parent = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    child = spark.createDataFrame([("a", 1), ("c", 1), ("c", 1), (None, 1)], "k string, v int")
    got = {r["check_name"]: r["value"] for r in integrity.integrity_report({"p": parent, "c": child}, [("c", ["k"], "p"), ("c", ["k", "v"], "p")]).collect()}
    assert got == {"rows_p": 2, "rows_c": 4, "orphans_c_k": 3, "orphans_c_k_v": 3}


def test_capital_accounts_roll_forward(spark):
    """Each period opens where the one before it closed."""
    from pyspark.sql import Window

    from acreledger.testbed.tables import Tables

    rows = pcap.investor_pcap(Tables(spark, "/root/testdata/sf0.001")).select(
        "investor_id", "fund_id", "period_id", "opening_balance_usd", "closing_balance_usd").distinct()
    before = F.lag("closing_balance_usd").over(Window.partitionBy("investor_id", "fund_id").orderBy("period_id"))
    steps = rows.withColumn("before", before).where("before IS NOT NULL")
    assert steps.count() > 100 and steps.where(F.abs(F.col("before") - F.col("opening_balance_usd")) > 0.001).count() == 0


def test_every_fund_of_a_tenant_with_customers_has_investors(spark):
    from acreledger.testbed.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.01")
    missing = t.funds.join(t.investors.select("arena_id").distinct(), "arena_id", "left_semi").join(t.investors.select("fund_id").distinct(), "fund_id", "left_anti")
    assert missing.count() == 0


def test_attribution_keeps_every_property_period(spark):
    from acreledger.testbed.registry import STAR_AS_OF
    from acreledger.testbed.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    assert fund_metrics.attribution_period(t, STAR_AS_OF).count() == fund_metrics._property_period(t, STAR_AS_OF, None).count()


def test_last_partial_bucket_is_kept(spark):
    raw = spark.createDataFrame([("r", "t", float(ms), True, 5.0) for ms in (0, 59_000, 99_000, 119_000, 120_000)],
                                "run_id string, target string, actual_start_offset_ms double, success boolean, total_latency_ms double")
    got = {r["bucket_start_offset_s"]: r["achieved_qps"] * 60 for r in latency.timeseries(raw, 60, 0, 100).collect()}
    assert {k: round(v) for k, v in got.items()} == {0: 2, 60: 2}
