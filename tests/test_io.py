"""Sources, sinks and streams on temporary folders."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from acreledger import schemas
from acreledger.operators.aggregates import dedupe
from acreledger.plans import dashboards, results, silver
from acreledger.sources import readers, writers
from acreledger.sources.storage import shared_dir
from acreledger.streaming import pipeline as st

D = dt.date


def gl_rows(n, start=0):
    return [(f"t{i}", f"a{i % 2}", "p", f"f{i % 3}", "4100", "Rent", "d", float(i), D(2024, 1 + i % 4, 1), "revenue", True) for i in range(start, start + n)]


GL = "transaction_id string, arena_id string, property_id string, fund_id string, account_code string, account_name string, description string, " \
     "amount double, transaction_date date, category string, posted boolean"


def test_partition_overwrite_touches_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "gl")
    df = spark.createDataFrame(gl_rows(40), GL).withColumns({"year": F.year("transaction_date"), "month": F.month("transaction_date")})
    writers.write_partitioned(df, path, ["year", "month"])
    writers.write_partitioned(df.where("month = 2").limit(1), path, ["year", "month"])
    got = {r["month"]: r["count"] for r in spark.read.parquet(path).groupBy("month").count().collect()}
    assert got == {1: 10, 2: 1, 3: 10, 4: 10}


def test_replace_by_key_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "runs")
    a = spark.createDataFrame([("r1", 1.0), ("r1", 2.0), ("r2", 3.0)], "run_id string, v double")
    writers.replace_by_key(a, path, "run_id")
    for _ in range(2):
        writers.replace_by_key(a.where("run_id = 'r2'").withColumn("v", F.lit(9.0)), path, "run_id")
    assert sorted((r["run_id"], r["v"]) for r in spark.read.parquet(path).collect()) == [("r1", 1.0), ("r1", 2.0), ("r2", 9.0)]


def test_append_casts_to_the_declared_schema(spark, tmp_path):
    path = str(tmp_path / "raw")
    writers.append_rows(spark.createDataFrame([("r1", "5")], "run_id string, concurrency string"), path, schemas.BENCHMARK_RAW)
    row = spark.read.parquet(path).first()
    assert row["concurrency"] == 5 and row["latency_ms"] is None


def test_json_keeps_nulls(spark, tmp_path):
    path = str(tmp_path / "j")
    writers.write_json_compact(spark.createDataFrame([("a", None)], "k string, v string"), path)
    files = list((tmp_path / "j").glob("*.json"))
    assert len(files) == 1 and files[0].read_text().strip() == '{"k":"a","v":null}'


def test_csv_round_trip_with_quotes(spark, tmp_path, rows):
    path = str(tmp_path / "c")
    df = spark.createDataFrame([('say "hi", you', 1.5), ("plain", None)], "n string, v double")
    writers.write_csv_header(df, path)
    back = spark.read.option("header", "true").option("escape", '"').schema(df.schema).csv(path)
    assert rows(back) == rows(df)


def test_results_csv_cells(spark, tmp_path):
    names = [f.name for f in schemas.BENCHMARK_RAW.fields]
    cells = {"run_id": "r1", "target": "wh", "concurrency": "5.0", "latency_ms": "None", "success": "True", "error": "", "queue_time_ms": "abc", "is_warmup": "no"}
    (tmp_path / "raw.csv").write_text(",".join(names) + "\n" + ",".join(cells.get(n, "") for n in names) + "\n")
    row = readers.read_results_csv(spark, str(tmp_path / "raw.csv"), schemas.BENCHMARK_RAW).first()
    assert (row["concurrency"], row["latency_ms"], row["success"], row["error"], row["queue_time_ms"], row["is_warmup"]) == (5, None, True, None, None, False)


def test_loading_a_result_directory_twice_keeps_one_copy(spark, tmp_path):
    out = str(tmp_path / "tables")
    for stamp, n in (("20240105_101530", 3), ("20240106_000000", 2), ("20240105_101530", 3)):
        d = tmp_path / stamp
        d.mkdir(exist_ok=True)
        (d / "raw_results.csv").write_text(
            "query_name,target,concurrency,iteration,thread_id,latency_ms,success,error,actual_start_offset_ms\n"
            + "".join(f"q,{'wh' if i else 'pg'},5,{i},0,{10.5 + i},True,,{i * 1000}\n" for i in range(n)))
        (d / "summary.csv").write_text("target,concurrency,query_name,total_queries,successful,failed,p50_ms,p95_ms,p99_ms,min_ms,max_ms,mean_ms,"
                                       "throughput_qps,error_rate\nwh,5,q,3,3,0,1,2,3,1,3,2,0.5,0.0\n")
        (d / "timeseries_buckets.csv").write_text("target,query_name,bucket_start_offset_s,bucket_end_offset_s,p50_ms,p95_ms,max_ms,achieved_qps,error_count,"
                                                  "is_warmup\nwh,__all__,0,30,1,2,3,4.7,0,True\n")
        run = results.load_results(spark, str(d), out, "scenario", 5).withColumn("ended_at", F.col("ended_at").cast("string")).first()
    assert (run["run_id"], run["targets"], run["mode"], run["ended_at"]) == (
        "2024-01-05T10:15:30Z", ["pg", "wh"], "sustained", "2024-01-05 10:16:02")
    counts = {t: spark.read.parquet(f"{out}/{t}").count() for t in (*results.FILES, "benchmark_runs")}
    assert counts == {"benchmark_raw": 5, "benchmark_summary": 2, "benchmark_summary_timeseries": 2, "benchmark_runs": 2}
    raw = spark.read.parquet(f"{out}/benchmark_raw").where("run_id = '2024-01-05T10:15:30Z'").orderBy("iteration").first()
    assert (raw["target"], raw["latency_ms"], raw["success"], raw["is_warmup"], raw["queue_time_ms"]) == ("pg", 10.5, True, False, None)


def test_clustered_layout_prunes_files(spark, tmp_path):
    path = str(tmp_path / "cl")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        writers.write_clustered(spark.createDataFrame(gl_rows(400), GL), path, ["arena_id", "transaction_date"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    by_file = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.min("arena_id").alias("lo"), F.max("arena_id").alias("hi")).collect()
    assert len(by_file) > 1 and sum(r["lo"] != r["hi"] for r in by_file) <= 1


def test_raw_root_needs_a_setting(spark):
    spark.conf.unset(readers.RAW_PATH_CONF)
    with pytest.raises(ValueError):
        readers.raw_root(spark)
    assert readers.raw_root(spark, "/data/") == "/data"


def test_shared_dir_is_the_sessions(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_table_or_files_prefers_the_table(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"arena_id":"x"}\n{"arena_id":"w"}\n{"arena_id":"x"}\n')
    assert [r[0] for r in readers.table_or_files(spark, "no_such_table", str(tmp_path), "arena_id").collect()] == ["w", "x"]
    spark.createDataFrame([("t",)], "arena_id string").createOrReplaceTempView("ids_view")
    assert [r[0] for r in readers.table_or_files(spark, "ids_view", str(tmp_path), "arena_id").collect()] == ["t"]


def test_stream_restarts_see_only_new_files(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    spark.createDataFrame([("a1", "A")], "arena_id string, arena_name string").write.json(src)
    for drop in range(2):
        if drop:
            spark.createDataFrame([("a2", "B")], "arena_id string, arena_name string").write.mode("append").json(src)
        st.ingest(readers.stream_json(spark, src, schemas.ARENAS), silver.arenas, out, chk)
        st.ingest(readers.stream_json(spark, src, schemas.ARENAS), silver.arenas, out, chk)
    got = spark.read.parquet(out)
    assert sorted(r["arena_id"] for r in got.collect()) == ["a1", "a2"] and got.where("_source_file IS NULL").count() == 0


def test_stream_equals_batch_for_silver(spark, tmp_path, rows):
    src = str(tmp_path / "in")
    df = spark.createDataFrame([("i1", "a1", "HNWI", "5.5"), (None, "a1", "PENSION", "1"), ("i2", "a1", "Pension", "x")],
                               "investor_id string, arena_id string, type string, commitment_amount string")
    writers.write_csv_header(df, src)
    st.ingest(spark.readStream.option("header", "true").schema(df.schema).csv(src), silver.investors, str(tmp_path / "out"), str(tmp_path / "chk"))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(silver.investors(df)) == [("i1", "a1", "hnwi", 5.5), ("i2", "a1", "pension", None)]


def test_stream_dedupe_keeps_the_first_row_of_a_session(spark, tmp_path):
    """Copies inside the delay give one whole row, the first by date and amount, wherever it arrives; later ones pass again or are ignored."""
    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    shape = "transaction_id string, transaction_date date, amount double, note string"
    drops = [[("t1", D(2024, 1, 3), 5.0, "second day"), ("n", None, 1.0, "no date")],
             [("t1", D(2024, 1, 1), 9.0, "earlier day"), ("t1", D(2024, 1, 1), 4.0, "least amount"), ("t1", D(2024, 1, 1), 4.0, "least note"), ("t2", D(2024, 1, 8), 1.0, "b")],
             [("t1", D(2024, 1, 10), 0.5, "within a week of the third")],
             [("t3", D(2024, 3, 1), 1.0, "c")],  # the watermark passes
             [("t1", D(2024, 1, 2), 0.1, "behind the watermark"), ("t1", D(2024, 2, 26), 7.0, "a new session")],
             [("t4", D(2024, 6, 1), 1.0, "closing")]]
    for rows_in in drops:
        spark.createDataFrame(rows_in, shape).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(shape).parquet(src)
        query = st.append_to(st.dedupe_within(stream, "transaction_id", "transaction_date", ["transaction_date", "amount"]), out, chk)
        query.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect() if r["transaction_date"])
    assert got == [("t1", D(2024, 1, 1), 4.0, "least amount"), ("t1", D(2024, 2, 26), 7.0, "a new session"), ("t2", D(2024, 1, 8), 1.0, "b"), ("t3", D(2024, 3, 1), 1.0, "c")]
    assert [r["transaction_id"] for r in spark.read.parquet(out).where("transaction_date IS NULL").collect()] == ["n"]
    assert query.lastProgress.stateOperators[0].numRowsTotal == 1  # the closing event alone


def test_table_functions_match_lookups(spark, rows):
    spark.createDataFrame([("F", "core", 5.0, 1, 1.0, 1.0, 0.0, 2), ("G", "debt", 9.0, 1, 1.0, 1.0, 0.0, 2)],
                          "fund_name string, strategy string, total_aum double, property_count long, total_invested double, "
                          "current_portfolio_value double, unrealized_gain_loss double, investor_count long").createOrReplaceTempView("tf_fund")
    spark.createDataFrame([("P", "office", "F", D(2024, 1, 1), 1.0, 1.0, 1.0, 0.5)], "property_name string, property_type string, fund_name string, "
                          "month date, revenue double, expenses double, noi double, occupancy_rate double").createOrReplaceTempView("tf_property")
    spark.createDataFrame([("F", "opex", D(2024, 1, 1), 1.0, 1, 1.0), ("F", "capex", D(2024, 2, 1), 1.0, 1, 1.0)], "fund_name string, category string, "
                          "month date, total_amount double, transaction_count long, avg_transaction_amount double").createOrReplaceTempView("tf_gl")
    for lookup, view in ((dashboards.FUND_LOOKUP, "tf_fund"), (dashboards.PROPERTY_LOOKUP, "tf_property"), (dashboards.LEDGER_LOOKUP, "tf_gl")):
        lookup.create(spark.table(view), view)
    ask = lambda lookup, given="": spark.sql(f"SELECT * FROM {lookup.name}({given})")
    assert ask(dashboards.FUND_LOOKUP).count() == 2
    assert rows(ask(dashboards.FUND_LOOKUP, "p_strategy => 'core'")) == rows(dashboards.FUND_LOOKUP.read(spark.table("tf_fund"), strategy="core"))
    assert ask(dashboards.FUND_LOOKUP, "p_min_aum => 6").count() == 1
    assert ask(dashboards.LEDGER_LOOKUP, "p_start => DATE '2024-01-15'").count() == 1
    assert rows(ask(dashboards.LEDGER_LOOKUP, "p_category => 'opex'")) == rows(dashboards.LEDGER_LOOKUP.read(spark.table("tf_gl"), category="opex"))
    assert ask(dashboards.PROPERTY_LOOKUP, "p_fund => 'F', p_type => 'office'").count() == 1


def test_latency_windows_close_behind_the_watermark(spark, tmp_path):
    """Append mode gives a window once events pass its end plus the delay; late rows of a closed window are ignored."""
    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    shape = "ts timestamp, success boolean, total_latency_ms double"
    at = lambda m, s=0: dt.datetime(2024, 1, 1, 0, m, s)
    drops = [[(at(0, 1), True, 10.0), (at(0, 20), True, 30.0), (at(0, 25), False, -1.0), (at(0, 40), True, 5.0)],
             [(at(5), True, 1.0)], [(at(0, 2), True, 999.0), (at(9), True, 1.0)]]
    for rows_in in drops:
        spark.createDataFrame(rows_in, shape).coalesce(1).write.mode("append").parquet(src)
        st.append_to(st.latency_windows(spark.readStream.schema(shape).parquet(src), "ts"), out, chk).awaitTermination()
    got = sorted((r["window_start"].minute, r["window_start"].second, r["total"], r["error_count"], r["max_ms"], r["p50_approx_ms"])
                 for r in spark.read.parquet(out).collect())
    assert got == [(0, 0, 3, 1, 30.0, 10.0), (0, 30, 1, 0, 5.0, 5.0), (5, 0, 1, 0, 1.0, 1.0)]


def test_sketched_percentiles_hold_their_rank_error_and_merge(spark, tmp_path):
    """Two windows of 6,000 events each: ranks within 2 %, also of the window made from both; closed windows leave the state."""
    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    shape = "ts timestamp, success boolean, total_latency_ms double"
    base = dt.datetime(2024, 1, 1)
    values = [float((i * 7919) % 12_000) for i in range(12_000)]
    drops = [[(base + dt.timedelta(seconds=30 * (i % 2) + i % 29), True, v) for i, v in enumerate(values)], [(base + dt.timedelta(hours=1), True, 1.0)]]
    for rows_in in drops:
        spark.createDataFrame(rows_in, shape).coalesce(2).write.mode("append").parquet(src)
        query = st.append_to(st.latency_windows(spark.readStream.schema(shape).parquet(src), "ts"), out, chk)
        query.awaitTermination()
    assert query.lastProgress.stateOperators[0].numRowsTotal == 1
    windows = spark.read.parquet(out)
    for half, r in enumerate(sorted(windows.collect(), key=lambda r: r["window_start"])):
        own = sorted(values[half::2])
        for p, found in ((0.5, r["p50_approx_ms"]), (0.95, r["p95_approx_ms"])):
            assert abs(own.index(found) / len(own) - p) <= 0.02
    both = st.rollup_windows(windows, "1 minute").collect()
    assert len(both) == 1 and both[0]["total"] == 12_000 and both[0]["max_ms"] == max(values)
    assert abs(both[0]["p95_approx_ms"] / 12_000 - 0.95) <= 0.02 and abs(both[0]["p50_approx_ms"] / 12_000 - 0.5) <= 0.02


def test_schema_log_opens_new_files_only(spark, tmp_path, monkeypatch):
    """Each update infers from what has landed since, also after one that died before it noted its files; CSV columns go by header."""
    opened, real = [], readers.infer_schema
    monkeypatch.setattr(readers, "infer_schema", lambda *args: opened.append(len(args[3])) or real(*args))
    known = "a string, b int"
    drops = ["a string, b int", "b int, c string, a string", "a string, d string"]
    for fmt in ("json", "csv", "parquet"):
        src, log, out = str(tmp_path / fmt), readers.SchemaLog(spark, str(tmp_path / f"log-{fmt}")), str(tmp_path / f"out-{fmt}")
        opened.clear()
        for i, shape in enumerate(drops):
            row = {"a": f"a{i}", "b": i, "c": "c", "d": "d"}
            names = [c.split()[0] for c in shape.split(", ")]
            spark.createDataFrame([tuple(row[n] for n in names)], shape).coalesce(1).write.mode("append").format(fmt).option("header", "true").save(src)
            if i == 1:  # dies after the schema, before the files are noted
                publish = log.schemas.replace
                log.schemas.replace = lambda df, publish=publish: publish(df) and 1 / 0
                with pytest.raises(ZeroDivisionError):
                    log.evolve(spark.createDataFrame([], known).schema, fmt, src)
                log.schemas.replace = publish
            schema = log.evolve(spark.createDataFrame([], known).schema, fmt, src)
            assert log.evolve(spark.createDataFrame([], known).schema, fmt, src) == schema
            if fmt == "csv":
                st.csv_by_header(spark, src, schema, out, f"{out}-chk").awaitTermination()
        assert opened == [1, 1, 1, 1]
        assert sorted(schema.names) == ["a", "b", "c", "d"]
        if fmt == "csv":
            got = spark.read.schema(schema).parquet(f"{out}/b*").select("a", "b", "c", "d").collect()
            assert sorted(tuple(r) for r in got) == [("a0", 0, None, None), ("a1", 1, "c", None), ("a2", None, None, "d")]
