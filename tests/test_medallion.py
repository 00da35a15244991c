"""Landing files to gold, twice, with new files and duplicates in between."""

import ledger_rows
from pyspark.sql import functions as F

from acreledger.plans import medallion
from acreledger.plans.medallion import read_table, rule_counts, run_update
from acreledger.session import PARTITION_BYTES, configure
from acreledger.sources import writers


def land(spark, raw, start, end):
    gl = ledger_rows.ledger(spark, start, end)
    gl.write.mode("append").partitionBy("year", "month").parquet(f"{raw}/gl_transactions")


def test_update_is_incremental_and_repeatable(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    writers.write_json_compact(ledger_rows.arenas(spark, 4), f"{raw}/arenas")
    writers.write_json_compact(ledger_rows.funds(spark, 0, 20), f"{raw}/funds")
    writers.write_csv_header(ledger_rows.investors(spark, 200), f"{raw}/investors")
    writers.write_parquet(ledger_rows.properties(spark, 40), f"{raw}/properties")
    land(spark, raw, 0, 600)

    first = {r["table_name"]: r for r in run_update(spark, out, "2026-01-01", raw).collect()}
    assert all(r["duplicate_keys"] == 0 for r in first.values())
    assert (first["gold_arena_overview"]["row_count"], first["gold_fund_performance"]["row_count"]) == (4, 20)

    again = {r["table_name"]: r["row_count"] for r in run_update(spark, out, "2026-01-01", raw).collect()}
    assert again == {n: r["row_count"] for n, r in first.items()}

    land(spark, raw, 500, 800)  # 100 transactions arrive a second time
    run_update(spark, out, "2026-01-01", raw)
    silver = read_table(spark, out, "gl_transactions")
    assert silver.count() == 800 and silver.select("transaction_id").distinct().count() == 800
    total = read_table(spark, out, "gold_gl_monthly_summary").agg(F.sum("transaction_count")).first()[0]
    assert total == 800
    assert spark.read.parquet(f"{out}/bronze/gl_transactions").count() == 900

    quality = rule_counts(spark, out)
    assert quality.count() == 10 and quality.agg(F.sum("violations")).first()[0] == 0
    extra = ledger_rows.funds(spark, 20, 22).withColumn("esg_rating", F.lit("A"))
    extra.withColumn("fund_id", F.lit(None).cast("string")).write.mode("append").json(f"{raw}/funds")
    extra.write.mode("append").json(f"{raw}/funds")
    wide = ledger_rows.ledger(spark, 790, 820).withColumn("desk", F.concat(F.lit("d"), "transaction_id"))
    wide.write.mode("append").partitionBy("year", "month").parquet(f"{raw}/gl_transactions")
    after = {r["table_name"]: r["row_count"] for r in run_update(spark, out, "2026-01-01", raw, evolve=True).collect()}
    assert after["gold_fund_performance"] == 22
    bronze = spark.read.option("mergeSchema", "true").parquet(f"{out}/bronze/funds")
    assert sorted(r["esg_rating"] or "" for r in bronze.collect()) == [""] * 20 + ["A"] * 4
    assert [tuple(r) for r in rule_counts(spark, out).where("violations > 0").collect()] == [("funds", "valid_fund_id", 2)]
    silver = read_table(spark, out, "gl_transactions")
    # of equal date and amount the copy without a desk comes first
    assert silver.count() == 820 and silver.where("desk = concat('d', transaction_id)").count() == 20


def contents(spark, out):
    tables = [*medallion.gold.PRIMARY_KEYS, "gl_transactions"]
    return {n: sorted(map(repr, read_table(spark, out, n).drop("_ingested_at").select(*sorted(c for c in read_table(spark, out, n).columns)).collect())) for n in tables}


def landing(spark, raw):
    writers.write_json_compact(ledger_rows.arenas(spark, 4), f"{raw}/arenas")
    writers.write_json_compact(ledger_rows.funds(spark, 0, 20), f"{raw}/funds")
    writers.write_csv_header(ledger_rows.investors(spark, 200), f"{raw}/investors")
    writers.write_parquet(ledger_rows.properties(spark, 40), f"{raw}/properties")


def test_an_update_rewrites_the_months_it_touches(spark, tmp_path, monkeypatch):
    """One new file of one month; copies that move two transactions to it; then another closing day. Each time as a full build."""
    raw, out, full = (str(tmp_path / n) for n in ("raw", "out", "full"))
    landing(spark, raw)
    land(spark, raw, 0, 600)
    run_update(spark, out, "2026-01-01", raw)
    table = medallion.ledger_table(spark, out)
    before = table.manifest()["folders"]
    gl = ledger_rows.ledger(spark, 600, 640).withColumns({"transaction_date": F.lit("2025-03-03").cast("date"), "month": F.lit(3)})
    moved = ledger_rows.ledger(spark, 290, 292).withColumns({"transaction_date": F.lit("2025-03-01").cast("date"), "month": F.lit(3)})  # were in October
    gl.unionAll(moved).write.mode("append").partitionBy("year", "month").parquet(f"{raw}/gl_transactions")
    # the update dies after the ledger's new months are published, and after the monthly base, and is run again
    for step in ("update_base", "stale"):
        real, calls = getattr(medallion, step), []

        def dies(*args, real=real, calls=calls, step=step):
            calls.append(1)
            if step == "stale" and len(calls) < 2:
                return real(*args)
            raise RuntimeError("lost")

        old = contents(spark, out)
        monkeypatch.setattr(medallion, step, dies)
        try:
            run_update(spark, out, "2026-01-01", raw)
            raise AssertionError("it should have died")
        except RuntimeError as e:
            assert "lost" in str(e)
        monkeypatch.setattr(medallion, step, real)
        now = contents(spark, out)
        assert all(now[n] == old[n] for n in ("gold_property_financials", "gold_gl_monthly_summary"))  # the old version stands
    run_update(spark, out, "2026-01-01", raw)
    after = table.manifest()["folders"]
    assert {m for m in after if before.get(m) != after[m]} == {"2025_03", "2025_10"}
    summary = medallion.Versioned(spark, f"{out}/gold/gold_gl_monthly_summary", "part")
    old, new = (summary.manifest(v)["folders"] for v in summary.versions()[-2:])
    assert {m for m in new if old.get(m) != new[m]} == {"2025_03", "2025_10"}
    run_update(spark, full, "2026-01-01", raw)
    assert contents(spark, out) == contents(spark, full)
    run_update(spark, out, "2026-03-15", raw)
    run_update(spark, str(tmp_path / "other"), "2026-03-15", raw)
    assert contents(spark, out) == contents(spark, str(tmp_path / "other"))


def test_versions_survive_a_crash_and_retire(spark, tmp_path, monkeypatch):
    from acreledger.sources import versioned
    from acreledger.sources.versioned import Versioned

    table = Versioned(spark, str(tmp_path / "t"), "part")
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "part string, n int")
    held = lambda version=None: sorted((r["part"], r["n"]) for r in table.read(version=version).collect())
    assert table.replace(rows(("a", 1), ("b", 2))) == 1
    monkeypatch.setattr(Versioned, "_switch", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    try:
        table.replace(rows(("a", 5)))
    except RuntimeError:
        pass
    assert held() == [("a", 1), ("b", 2)]
    monkeypatch.undo()
    table.replace(rows(("a", 7)), only=["a", "c"], meta={"batch": 4})
    assert held() == [("a", 7), ("b", 2)] and held(1) == [("a", 1), ("b", 2)] and table.meta == {"batch": 4}
    table.replace(rows(), only=["a"])
    assert held() == [("b", 2)] and table.read(["a"]).count() == 0
    for n in range(4):
        table.replace(rows(("b", n)), only=["b"])
    assert table.versions() == [5, 6, 7][-versioned.KEEP:] and held() == [("b", 3)]
    assert len(list((tmp_path / "t" / "data").glob("load=*/part=*"))) == versioned.KEEP
    whole = Versioned(spark, str(tmp_path / "w"))
    whole.replace(spark.range(3))
    whole.replace(spark.range(5))
    assert whole.read().count() == 5 and whole.read(version=1).count() == 3


def test_rule_counts_over_many_bounded_batches_and_a_retry(spark, tmp_path, monkeypatch):
    """101 batches of one file, each with one broken row; one batch dies after its counts are written."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(202).selectExpr("IF(id % 2 = 0, concat('A', id), NULL) AS arena_id", "'n' AS arena_name", "id DIV 2 AS file").repartitionByRange(101, "file").drop("file").write.parquet(src)
    stream = lambda: spark.readStream.schema("arena_id string, arena_name string").option("maxFilesPerTrigger", 1).parquet(src)
    real, calls = medallion.log_counts, []

    def dies_once(*args):
        real(*args)
        calls.append(1)
        if len(calls) == 50:
            raise RuntimeError("lost")

    monkeypatch.setattr(medallion, "log_counts", dies_once)
    for _ in range(2):
        try:
            medallion.dimension_stream("arenas", stream(), out).awaitTermination()
        except Exception as e:  # noqa: BLE001
            assert "lost" in str(e)
    files = len(list((tmp_path / "in").glob("*.parquet")))
    assert len(calls) == files + 1 and files >= 101
    assert [tuple(r) for r in rule_counts(spark, out).collect()] == [("arenas", "valid_arena_id", 101)]
    assert spark.read.parquet(f"{out}/silver/arenas").count() == 101


def test_shuffle_sizing_grows_with_the_input(spark, tmp_path):
    from acreledger.session import EXPANSION, input_listing

    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a").write_bytes(b"x" * 1000)
    small, listing = input_listing(spark, str(tmp_path))
    (tmp_path / "t" / "b").write_bytes(b"x" * 5000)
    large, other = input_listing(spark, str(tmp_path))
    assert (small, large) == (1000, 6000) and listing != other
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        counts = [int(configure(spark, EXPANSION * n * PARTITION_BYTES).conf.get("spark.sql.shuffle.partitions")) for n in (small, large)]
        assert counts == [4000, 24000]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_shuffle_sizing(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        configure(spark, 1000 * PARTITION_BYTES + 1)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "1001"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
