"""What an update moves: whole ledger rows once, to their transaction's state; monthly tables are written where folds and scans leave rows."""

import ledger_rows
from pyspark.sql import functions as F

from acreledger.plans import medallion
from acreledger.plans.medallion import run_update
from acreledger.session import IN_PLACE, RELEASE, configure, settings
from acreledger.sources import writers
from acreledger.sources.versioned import Versioned
from acreledger.streaming.ledger import kept_copies


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_whole_rows_are_dealt_before_they_fold(spark, tmp_path):
    """A fold in the reading tasks would sort, and spill, all rows that such a task reads."""
    rows = ledger_rows.ledger(spark, 0, 50).union(ledger_rows.ledger(spark, 40, 60))
    found = plan(kept_copies(rows))
    assert found.count("Exchange") == 1 and found.rindex("HashAggregate") < found.index("Exchange")
    assert kept_copies(rows).count() == 60


def test_an_update_shuffles_no_monthly_table_by_month(spark, tmp_path, monkeypatch):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    writers.write_json_compact(ledger_rows.arenas(spark, 4), f"{raw}/arenas")
    writers.write_json_compact(ledger_rows.funds(spark, 0, 20), f"{raw}/funds")
    writers.write_csv_header(ledger_rows.investors(spark, 200), f"{raw}/investors")
    writers.write_parquet(ledger_rows.properties(spark, 40), f"{raw}/properties")
    frame, asked, plans = type(spark.range(1)), [], {}
    hint, replace = frame.hint, Versioned.replace
    monkeypatch.setattr(frame, "hint", lambda self, name, *a: asked.append((name, *a)) or hint(self, name, *a))

    def seen(self, df, *a, **b):
        plans.setdefault(self.root.rsplit("/", 1)[1], plan(df))
        return replace(self, df, *a, **b)

    monkeypatch.setattr(Versioned, "replace", seen)
    before = {key: spark.conf.get(key, None) for key in IN_PLACE}
    for start, end in ((0, 600), (500, 800)):
        ledger_rows.ledger(spark, start, end).write.mode("append").partitionBy("year", "month").parquet(f"{raw}/gl_transactions")
        run_update(spark, out, "2026-01-01", raw)
    assert asked == []
    assert "Exchange" not in plans["gl_transactions"]  # the first batch's changes, as their files are read
    # the base moves to its property once, which serves the fold and the join
    assert plans["gold_property_financials"].count("Exchange hashpartitioning(arena_id") == 0
    assert medallion.read_table(spark, out, "gl_transactions").count() == 800
    assert medallion.read_table(spark, out, "gold_gl_monthly_summary").agg(F.sum("transaction_count")).first()[0] == 800
    assert {key: spark.conf.get(key, None) for key in IN_PLACE} == before


def test_settings_end_with_their_jobs(spark):
    key = "spark.sql.parquet.compression.codec"
    before = spark.conf.get(key, None)
    try:
        with settings(spark, {key: "zstd", "acreledger.none": "1"}):
            assert spark.conf.get(key) == "zstd"
            raise ValueError
    except ValueError:
        pass
    assert spark.conf.get(key, None) == before and spark.conf.get("acreledger.none", None) is None


def test_spread_partitions_replace_their_own_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda low, high, n: spark.range(low, high).select("id", (F.col("id") % 3).alias("part"), F.lit(n).alias("n"))
    writers.write_partitioned(rows(0, 30, 1), path, ["part"], spread=True)
    writers.write_partitioned(rows(0, 30, 2).where("part = 1"), path, ["part"], spread=True)
    assert sorted(tuple(r) for r in spark.read.parquet(path).groupBy("part", "n").count().collect()) == [(0, 1, 10), (1, 2, 10), (2, 1, 10)]
    assert "Exchange" not in plan(rows(0, 30, 1))


def test_spread_versions_keep_other_partitions(spark, tmp_path):
    table = Versioned(spark, str(tmp_path / "t"), "part")
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "part string, n int")
    table.replace(rows(("a", 1), ("b", 2), ("b", 4)), cluster=["n"], spread=True)
    table.replace(rows(("a", 3)), only=["a"], spread=True)
    assert sorted((r["part"], r["n"]) for r in table.read().collect()) == [("a", 3), ("b", 2), ("b", 4)]


def test_updates_pack_state_and_drop_shuffle_files(spark):
    """State is on disk twice; shuffle files of an update's writes go with them."""
    assert configure(spark).conf.get("spark.sql.streaming.stateStore.rocksdb.compression") == "zstd"
    for values in (IN_PLACE, writers.SPREAD):
        assert RELEASE.items() <= values.items()
