"""How often the ledger and the report facts are read and shuffled."""

import pytest

from acreledger.operators import aggregates as ag
from acreledger.plans import fund_metrics, lakehouse, pcap, silver
from acreledger.plans.lakehouse import SPREAD, Lakehouse
from acreledger.sources import writers
from acreledger.testbed import catalog
from acreledger.testbed.registry import AS_OF, STAR_AS_OF
from acreledger.testbed.tables import Tables

COPIES = [("k1", "2000-01-02", 5.0, "a", "x", 1), ("k1", "2000-01-01", 5.0, "b", "x", 2), ("k1", "2000-01-01", 5.0, "a", "z", 3),
          ("k1", "2000-01-01", 5.0, "a", None, 4), ("k2", None, None, "a", "y", 5), ("k2", None, 1.0, "c", "y", 6), (None, "2000-01-01", 1.0, "b", "y", 7),
          (None, "2000-01-01", 1.0, "b", "x", 8), ("k3", "2000-01-05", 2.0, None, None, None), ("k3", "2000-01-05", 2.0, None, None, None)]
SCHEMA = "id string, day string, amount double, tenant string, note string, late int"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan()


@pytest.mark.parametrize("wanted", [["id"], ["id", "amount"], ["tenant", "id"], ["id", "day", "note"], SCHEMA.replace(" string", "").replace(" double", "").replace(" int", "").split(", ")])
def test_wanted_columns_are_those_of_the_whole_kept_rows(spark, rows, wanted):
    df = spark.createDataFrame(COPIES, SCHEMA).repartition(3)
    whole = ag._one_per_key(df, ["id"], ["day", "amount"], descending=False)
    for counted in (True, False):
        got = ag.dedupe(df, "id", ["day", "amount"], wanted, counted)
        assert got.columns == wanted and rows(got) == rows(whole.select(*wanted))
    assert rows(ag.dedupe(df, "id", ["day", "amount"], counted=False)) == rows(whole)


def test_the_raw_ledger_is_read_once_and_without_late_columns(spark, tmp_path):
    columns = "transaction_id string, arena_id string, property_id string, fund_id string, amount double, transaction_date date, category string, currency string"
    spark.createDataFrame([], columns).write.parquet(str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    plan = silver.gl_transactions(raw)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1 and "currency" in plan
    plan = optimized(silver.gl_transactions(raw, silver.MEASURED)).toString()
    assert plan.count("Relation [") == 1 and "__rn" in plan
    kept = silver.gl_transactions(raw, silver.MEASURED)._jdf.queryExecution().sparkPlan().toString()
    assert "currency" not in kept.split("ReadSchema")[1]


def test_sorted_files_without_a_shuffle(spark, tmp_path, rows):
    assert SPREAD == {"silver_gl_transactions"}
    df = spark.range(200).selectExpr("concat('A', id % 3) AS tenant", "id").repartition(4)
    path = str(tmp_path / "sorted")
    writers.write_sorted(df, path, ["tenant", "id"])
    back = spark.read.parquet(path)
    assert rows(back) == rows(df)
    for file in back.inputFiles():
        found = [tuple(r) for r in spark.read.parquet(file).collect()]
        assert found == sorted(found)


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    """Base tables of two nations, four funds, eight properties and sixty orders."""
    root = str(tmp_path_factory.mktemp("star"))
    base = {
        "region": ("1", "CAST(id AS INT) AS r_regionkey", "'R' AS r_name"),
        "nation": ("2", "CAST(id AS INT) AS n_nationkey", "concat('N', id) AS n_name", "0 AS n_regionkey"),
        "supplier": ("4", "id AS s_suppkey", "concat('S', id) AS s_name", "CAST(id % 2 AS INT) AS s_nationkey", "CAST(id AS DOUBLE) AS s_acctbal"),
        "customer": ("10", "id AS c_custkey", "concat('C', id) AS c_name", "CAST(id % 2 AS INT) AS c_nationkey", "CAST(id AS DOUBLE) AS c_acctbal", "'BUILDING' AS c_mktsegment"),
        "part": ("8", "id AS p_partkey", "concat('P', id) AS p_name", "'B' AS p_brand", "'PROMO' AS p_type", "1 AS p_size", "CAST(100 + id AS DOUBLE) AS p_retailprice"),
        "orders": ("60", "id AS o_orderkey", "id % 10 AS o_custkey", "'F' AS o_orderstatus", "CAST(10 + id AS DOUBLE) AS o_totalprice",
                   "timestamp_seconds(820000000 + id * 5000000) AS o_orderdate", "element_at(array('1-URGENT', '3-MEDIUM', '5-LOW'), CAST(1 + id % 3 AS INT)) AS o_orderpriority"),
        "lineitem": ("240", "id % 61 AS l_orderkey", "id % 8 AS l_partkey", "id % 4 AS l_suppkey", "CAST(1 + id % 7 AS INT) AS l_linenumber", "1D AS l_quantity",
                     "CAST(50 + id AS DOUBLE) AS l_extendedprice", "0.1D AS l_discount", "0.05D AS l_tax", "element_at(array('N', 'A', 'R'), CAST(1 + id % 3 AS INT)) AS l_returnflag",
                     "'F' AS l_linestatus", "IF(id % 11 = 0, NULL, timestamp_seconds(830000000 + (id % 50) * 3000000)) AS l_shipdate"),
        "events": ("90", "id AS event_id", "timestamp_seconds(820000000 + id * 1000) AS ts", "id % 6 AS user_id", "'signup' AS event_type", "CAST(id AS DOUBLE) AS value", "'{\"a\": 1}' AS props"),
        "documents": ("5", "id AS doc_id", "'t' AS text", "'en' AS lang", "'src0' AS source", "10L AS n_chars"),
    }
    for name, (n, *columns) in base.items():
        spark.range(int(n)).selectExpr(*columns).coalesce(1).write.parquet(f"{root}/{name}.parquet")
    return Tables(spark, root)


def last_join(df):
    node = optimized(df)
    while node.nodeName() != "Join":
        node = node.children().head()
    return node


def test_report_facts_meet_everything_else_once(star, rows):
    short = fund_metrics.attribution_period(star, STAR_AS_OF)
    assert "Join" not in last_join(short).left().toString()
    full = fund_metrics.fund_rollup(star, STAR_AS_OF, ["signup"])
    assert "fund_name" not in last_join(full).left().toString()
    facts = fund_metrics._property_period(star, STAR_AS_OF, None)
    key = ["fund_id", "property_id", "period_id"]
    assert facts.count() > 20
    assert rows(short.select(*key, "property_attribution_usd")) == rows(facts.select(*key, "property_pl_usd"))
    current = star.dim_fund.where("is_current").select("fund_id")
    assert rows(full.select(*key, "property_pl_usd")) == rows(facts.join(current, "fund_id").select(*key, "property_pl_usd"))


@pytest.mark.parametrize("name", ["gold_gl_monthly_summary", "gold_property_financials", "gold_arena_overview"])
def test_one_rollup_alone_writes_no_monthly_base(spark, star, rows, name):
    alone, update = Lakehouse(spark, star, f"alone {name}", AS_OF), Lakehouse(spark, star, f"update {name}", AS_OF)
    found = rows(alone.table(name))
    assert found and "silver_gl_transactions" in alone._built[alone.root] and "silver_gl_monthly" not in alone._built[alone.root]
    update.table("silver_gl_monthly")
    assert "silver_gl_monthly" in update.ledger().inputFiles()[0]
    assert found == rows(update.table(name))


def test_a_count_of_the_ledger_shuffles_rules_and_order_alone(spark, star, rows):
    counted = silver.gl_transactions(star.gl_raw, silver.COUNTED)
    plan = optimized(counted.groupBy().count()).toString().split("Window")[1]
    assert "category" not in plan.splitlines()[0] and "counterparty_id" not in plan.splitlines()[0]
    kept = silver.gl_transactions(star.gl_raw, silver.MEASURED)
    assert rows(counted.select(*silver.COUNTED)) == rows(kept.select(*silver.COUNTED))
    report = {r.table_name: r for r in catalog.QUERIES["pub_reconcile_counts"](spark, star.sf_dir).collect()}
    assert report["silver_gl"].source_rows == report["silver_gl"].target_rows == kept.count() > 0


def test_the_precomputed_statement_is_written_without_a_range_shuffle(spark, star, rows, monkeypatch):
    monkeypatch.setattr(lakehouse, "write_clustered", None)
    table = Lakehouse(spark, star, "statement", AS_OF, STAR_AS_OF).table("gold_investor_pcap")
    assert rows(table) == rows(pcap.investor_pcap(star)) != []
    for file in table.inputFiles():
        found = [tuple(r) for r in spark.read.parquet(file).select(*lakehouse.CLUSTERING["gold_investor_pcap"]).collect()]
        assert found == sorted(found, key=lambda r: [v or "" for v in r])
