"""What stays on disk: shuffle files go with the write they served, wide rows move to their (fund, period) alone, state is packed."""

import re
import time

import pytest
from pyspark.sql import functions as F
from test_ledger_scale import star  # noqa: F401

from acreledger.plans import fund_metrics, lakehouse
from acreledger.plans.lakehouse import Lakehouse
from acreledger.session import RELEASE, configure, settings
from acreledger.sources.storage import staged
from acreledger.testbed import catalog, q_io
from acreledger.testbed.registry import AS_OF, STAR_AS_OF


def shuffles(spark):
    """Shuffle files of this session's only executor."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}


def left_over(spark, before):
    for _ in range(40):
        if not shuffles(spark) - before:
            return set()
        time.sleep(0.25)
    return shuffles(spark) - before


def folded(spark):
    return spark.range(1000).groupBy((F.col("id") % 100).alias("k")).agg(F.sum("id").alias("n"))


def test_staging_leaves_no_shuffle_files(spark, rows):
    before, key = shuffles(spark), next(iter(RELEASE))
    set_before = spark.conf.get(key)
    written = staged(folded(spark), "folded")
    assert left_over(spark, before) == set() and spark.conf.get(key) == set_before
    assert rows(written) == rows(folded(spark)) != []


def test_a_built_table_leaves_no_shuffle_files(spark, star):  # noqa: F811
    before = shuffles(spark)
    lake = Lakehouse(spark, star, "release", AS_OF)
    lake.table("gold_fund_performance")
    assert lake.table("silver_gl_transactions") is not None
    assert left_over(spark, before) == set()


def test_a_closed_stream_packs_its_state_and_rows(spark, star, rows, monkeypatch):  # noqa: F811
    paths, fresh = [], q_io.fresh
    monkeypatch.setattr(q_io, "fresh", lambda x, label: paths.append(fresh(x, label)) or paths[-1])
    codec = spark.conf.get("spark.sql.parquet.compression.codec")
    kept = catalog.QUERIES["st_dedupe"](spark, star.sf_dir)
    assert configure(spark).conf.get("spark.sql.streaming.stateStore.rocksdb.compression") == "zstd"
    assert spark.conf.get("spark.sql.parquet.compression.codec") == codec
    files = [*spark.read.parquet(f"{paths[0]}/in").inputFiles(), *kept.inputFiles()]
    assert kept.count() > 20 and all(f.endswith(".zstd.parquet") for f in files)


def test_the_precomputed_report_is_written_without_a_range_shuffle(spark, star, rows, monkeypatch):  # noqa: F811
    monkeypatch.setattr(lakehouse, "write_clustered", None)
    table = Lakehouse(spark, star, "report", AS_OF, STAR_AS_OF).table("gold_fund_attribution_period")
    assert rows(table) == rows(fund_metrics.attribution_period(star, STAR_AS_OF)) != []
    for file in table.inputFiles():
        found = [tuple(r) for r in spark.read.parquet(file).select(*lakehouse.CLUSTERING["gold_fund_attribution_period"]).collect()]
        assert found == sorted(found, key=lambda r: [v or "" for v in r])


def small_star(spark):
    table = lambda schema, *values: spark.createDataFrame(list(values), schema)
    return {
        "dim_fund": table("fund_id string, fund_name string, vintage_year int, fund_type_code string, holding_strategy_code string, is_current boolean",
                          ("f1", "One", 2015, "CE", "h", True), ("f2", "Two", 2016, "CE", None, True), ("f2", "Two again", 2016, "CE", "h", True),
                          ("f3", "Gone", 2016, "CE", "h", False), ("f4", "No type", 2016, "??", "h", True), (None, "None", 2016, "CE", "h", True)),
        "dim_fund_type": table("fund_type_code string, fund_type_name string", ("CE", "Closed-end")),
        "ref_holding_strategy": table("strategy_code string, strategy_name string", ("h", "Hold")),
        "dim_property": table("property_id string, property_name string, property_type_code string, msa_code string",
                              *[(f"p{i}", f"House {i}", "T", "m") for i in range(6)], ("p1", "House 1 again", "T", None), (None, "None", "T", "m"), ("p6", "No type", "?", "m")),
        "dim_property_type": table("property_type_code string, property_type_name string", ("T", "Home")),
    }


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_wide_report_rows_move_to_their_fund_and_period_alone(spark, rows, monkeypatch, broadcast):
    s = small_star(spark)
    cells = [(f, p, q, d, float(i)) for i, (f, p, q, d) in enumerate(
        (f, p, q, d) for f in ("f1", "f2", "f3", "f4", None) for p in ("p0", "p1", "p5", "p6", "p9", None) for q, d in (("FY1999_Q1", "1999-03-31"), ("FY1999_Q2", "1999-06-30"), ("FY2009_Q1", "2009-03-31"), (None, None), (None, "1999-01-01"), ("", "1999-01-02")))]
    gold = spark.createDataFrame([*cells, *cells[:9]], "fund_id string, property_id string, period_id string, period_end string, gross_nav double").withColumn("period_end", F.to_date("period_end")).repartition(3)
    plans = []

    def seen(df, label):
        found = spark.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        plans.append([b for b in re.split(r"\n\n", found) if re.match(r"\(\d+\) Exchange", b)])
        return staged(df, label)

    monkeypatch.setattr(fund_metrics, "staged", seen)
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": broadcast}):
        got = fund_metrics.attribution_report(gold, s, "2000-12-31")
    funds = s["dim_fund"].where("is_current").join(s["dim_fund_type"], "fund_type_code").join(s["ref_holding_strategy"], F.col("holding_strategy_code") == F.col("strategy_code"), "left")
    funds = funds.select("fund_id", "fund_name", "vintage_year", "fund_type_name", F.col("strategy_name").alias("holding_strategy_name"))
    props = s["dim_property"].join(s["dim_property_type"], "property_type_code").select("property_id", "property_name", "property_type_name", "msa_code")
    want = gold.where("period_end <= '2000-12-31'").join(funds, "fund_id").join(props, "property_id")
    assert got.columns == want.columns and rows(got) == rows(want) != []
    ordered = [(r.fund_id, r.period_id is not None, r.period_id or "", r.property_id) for r in got.collect()]
    assert ordered == sorted(ordered)
    if broadcast == "-1":
        wide = [b for b in plans[0] if "gross_nav" in b.split("Arguments")[0]]
        moved = [b.split("Arguments")[1] for b in wide if "repartition(3)" not in b and "REPARTITION_BY_NUM" not in b]
        assert len(moved) == 1 and "hashpartitioning(fund_id" in moved[0] and "property_id" not in moved[0]


def test_fund_periods_are_written_before_the_facts_move(star, monkeypatch):  # noqa: F811
    labels = []
    monkeypatch.setattr(fund_metrics, "staged", lambda df, label: labels.append(label) or staged(df, label))
    assert fund_metrics.fund_rollup(star, STAR_AS_OF, ["signup"]).count() > 0
    assert labels == ["property_period", "fund_period"]
