"""Operators on small hand-made frames: NULLs, ties, duplicates, empty input."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from acreledger.functions import money as m
from acreledger.functions import scalars as s
from acreledger.operators import aggregates as ag
from acreledger.operators import joins as jn
from acreledger.operators import ordering as so
from acreledger.operators import predicates as flt
from acreledger.operators import publish as pub


def test_expectations_drop_and_count(spark, rows):
    df = spark.createDataFrame([("t1", "a", 1.0), (None, "a", 2.0), ("t3", None, 3.0), ("t4", "a", None), (None, None, None)],
                               "transaction_id string, arena_id string, amount double")
    rules = {"id": "transaction_id IS NOT NULL", "amount": "amount IS NOT NULL", "arena": "arena_id IS NOT NULL"}
    seen = Observation("rules")
    assert rows(flt.expect_or_drop(df, rules, seen)) == [("t1", "a", 1.0)]
    assert seen.get == {"id": 2, "amount": 2, "arena": 2}
    assert rows(flt.violation_counts(df, rules)) == [("amount", 2), ("arena", 2), ("id", 2)]


def test_rule_that_is_null_drops_the_row(spark):
    df = spark.createDataFrame([(None,), (5,)], "x int")
    assert flt.expect_or_drop(df, {"positive": "x > 0"}).count() == 1


def test_dedupe_is_deterministic(spark, rows):
    data = [("k", 2, "b"), ("k", 1, "z"), ("k", 1, "a"), ("k", 1, None), ("u", 5, "x"), (None, 1, "n"), (None, 0, "n")]
    for parts in (1, 5):
        df = spark.createDataFrame(data, "key string, o int, v string").repartition(parts)
        assert rows(ag.dedupe(df, "key", ["o"])) == sorted([("k", 1, None), ("u", 5, "x"), (None, 0, "n")], key=repr)


def test_dedupe_limits_hot_keys_before_the_shuffle(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 990, "hot").otherwise("rest").alias("key"), F.col("id").alias("o"))
    plan = ag.dedupe(df, "key", ["o"])._jdf.queryExecution().executedPlan().toString()
    between = plan[plan.index("WindowGroupLimit") : plan.rindex("WindowGroupLimit")]  # the final limit, the shuffle of rows, the limit of a task
    assert plan.count("WindowGroupLimit") == 2 and between.count("Exchange hashpartitioning(key") == 1


def test_latest_per_key(spark, rows):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", None, "z")], "k string, t int, v string")
    assert rows(ag.latest_per_key(df, ["k"], ["t"])) == [("a", 2, "y"), ("b", None, "z")]


def test_group_value_joins_null_keys(spark, rows):
    df = spark.createDataFrame([(None, 1.5), (None, 2.5), ("a", 1.0)], "k string, v double")
    assert rows(ag.with_group_value(df, ["k"], total=m.money_sum("v"))) == sorted(
        [("a", 1.0, 1.0), (None, 1.5, 4.0), (None, 2.5, 4.0)], key=repr)


def test_money_does_not_depend_on_partitioning(spark):
    df = spark.range(10_000).select((F.col("id") * 0.1 + 0.01).alias("v"))
    sums = {df.repartition(n).agg(m.money_sum("v").alias("s")).first()["s"] for n in (1, 3, 16)}
    assert sums == {round(sum(round(i * 0.1 + 0.01, 2) for i in range(10_000)), 2)}


def test_money_total_survives_long_overflow(spark):
    df = spark.range(200).select(F.lit(9e14).alias("v"))
    assert df.agg(m.money_total("v").alias("s")).first()["s"] == pytest.approx(200 * 9e14)


def test_ratio_and_power(spark):
    r = spark.range(1).select(
        m.safe_ratio(F.lit(1.0), F.lit(0.0)).alias("a"), s.power_proxy(F.lit(-1.0)).alias("b"), s.power_proxy(F.lit(16.0)).alias("c"),
        m.round_half_up(F.lit(2.345), 2).alias("d")).first()
    assert (r["a"], r["b"], r["c"]) == (None, None, 1.0) and r["d"] == pytest.approx(2.35)


def test_padded_id_keeps_wide_keys(spark):
    r = spark.range(1).select(s.padded_id("X", F.lit(7), 3).alias("a"), s.padded_id("X", F.lit(12345), 3).alias("b")).first()
    assert (r["a"], r["b"]) == ("X-007", "X-12345")


def test_pick_by_share_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.0999,), (0.1,), (0.4,), (0.9999,)], "u double")
    got = [r[0] for r in df.select(s.pick_by_share(F.col("u"), {"p": 0.1, "g": 0.3, "s": 0.6})).collect()]
    assert got == ["p", "p", "g", "s", "s"]
    with pytest.raises(ValueError):
        s.pick_by_share(F.col("u"), {"a": 0.5, "b": 0.6})


def test_pick_by_key_takes_any_long(spark):
    df = spark.createDataFrame([(-(2**63),), (-1,), (0,), (4,)], "k long")
    assert [r[0] for r in df.select(s.pick_by_key(F.col("k"), ["a", "b", "c", "d"])).collect()] == ["a", "d", "a", "a"]


def test_attach_all_has_no_size_limit(spark):
    left, big = spark.range(3).withColumnRenamed("id", "l"), spark.range(5000).withColumnRenamed("id", "r")
    assert jn.attach_all(left, big).count() == 15_000
    assert jn.attach_all(left, big.limit(0), "left").count() == 3


def test_attach_literal_keeps_rows_without_a_match(spark, rows):
    left = spark.range(2).withColumnRenamed("id", "l")
    ref = spark.createDataFrame([("A", "one"), ("B", "two")], "code string, name string")
    assert rows(jn.attach_literal(left, ref, "code", "B")) == [(0, "two"), (1, "two")]
    assert rows(jn.attach_literal(left, ref, "code", "Z")) == [(0, None), (1, None)]
    assert jn.attach_literal(left, ref, "code", "Z", "inner").count() == 0


def test_left_many_equals_left_join(spark, rows):
    left = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, l int")
    right = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "n"), ("c", "z")], "k string, r string")
    assert rows(jn.left_many(left, right, "k")) == rows(left.join(right, "k", "left"))


def test_rank_ties_and_short_groups(spark):
    df = spark.createDataFrame([("a", v) for v in (5, 5, 4, 3)] + [("b", 1)], "g string, v int")
    top = so.top_per_group(df, ["g"], [F.desc("v")], 2)
    assert sorted((r["g"], r["v"], r["rnk"]) for r in top.collect()) == [("a", 5, 1), ("a", 5, 1), ("b", 1, 1)]


def test_running_sum_gives_peers_one_total(spark):
    df = spark.createDataFrame([("f", "p1", 1.0), ("f", "p1", 2.0), ("f", "p2", 4.0)], "f string, p string, v double")
    got = sorted((r["p"], r["c"]) for r in so.running_sum(df, ["f"], "p", "v", "c").collect())
    assert got == [("p1", 3.0), ("p1", 3.0), ("p2", 7.0)]


def test_union_padded(spark, rows):
    a = spark.createDataFrame([(1, "x")], "k int, c string")
    b = spark.createDataFrame([(2,)], "k int")
    assert rows(so.union_padded(a, b)) == [(1, "x"), (2, None)]


def test_optional_params(spark):
    df = spark.createDataFrame([("core", 5.0), ("debt", 9.0)], "strategy string, aum double")
    assert flt.optional_params(df, {"strategy": ("=", None), "aum": (">=", None)}).count() == 2
    assert flt.optional_params(df, {"strategy": ("=", "core"), "aum": (">=", 6.0)}).count() == 0


def test_contains_looks_into_structs(spark):
    df = spark.createDataFrame([(1, ("boss@x", 401)), (2, ("y", 200))], "id int, r struct<email: string, status: int>")
    assert [r["id"] for r in flt.contains_any(df, ["r"], "401").collect()] == [1]


OLD = [(1, "a", 1.0), (2, "b", 2.0), (3, "c", None), (4, "d", 4.0)]
NEW = [(1, "a", 1.0), (2, "b", 2.5), (3, "c", 3.0), (5, "e", None)]
SHAPE = "k int, n string, v double"


def test_snapshot_diff_and_apply(spark, rows):
    old, new = spark.createDataFrame(OLD, SHAPE), spark.createDataFrame(NEW, SHAPE)
    diff = pub.snapshot_diff(old, new, ["k"])
    assert sorted((r["k"], r["change_type"]) for r in diff.collect()) == [
        (1, "unchanged"), (2, "update"), (3, "update"), (4, "delete"), (5, "insert")]
    assert rows(pub.apply_changes(old, diff, ["k"])) == sorted(NEW, key=repr)
    assert rows(pub.apply_changes(old, pub.snapshot_diff(old, old, ["k"]), ["k"])) == sorted(OLD, key=repr)


def test_reconcile_statuses(spark):
    a, b = spark.range(3), spark.range(2)
    report = pub.reconcile({"same": a, "less": a, "gone": a}, {"same": spark.range(3), "less": b, "gone": None})
    assert sorted(map(tuple, report.collect())) == [("gone", 3, None, "skipped"), ("less", 3, 2, "mismatch"), ("same", 3, 3, "ok")]
    with pytest.raises(PySparkException):
        pub.require_reconciled(report).collect()


def test_pk_violations(spark, rows):
    df = spark.createDataFrame([("p", 1, "a1"), ("p", 1, "a2"), ("q", 1, "a1")], "property_id string, month int, arena_id string")
    assert rows(pub.pk_violations(df, ["property_id", "month"])) == [("p", 1, 2)]
    assert pub.pk_violations(df, ["arena_id", "property_id", "month"]).count() == 0


def test_dedupe_counts_keys_first(spark, rows):
    """Lone rows pass unsorted; repeated ones, nulls among them, are ranked as a window over everything would."""
    from acreledger.operators import aggregates

    data = [(f"k{i}", i, float(i), "x") for i in range(300)] + [(f"k{i}", i - 5, float(-i), "y") for i in range(0, 300, 7)]
    data += [("hot", i % 40, None, None) for i in range(2000)] + [(None, 3, 1.0, "n"), (None, 2, 1.0, "n"), (None, None, 9.0, "n")]
    df = spark.createDataFrame(data, "k string, d int, amount double, note string")
    got = aggregates.dedupe(df, "k", ["d", "amount"])
    assert rows(got) == rows(aggregates._one_per_key(df, ["k"], ["d", "amount"], descending=False))
    assert aggregates.repeated_buckets(df, "k").count() <= 300 // 7 + 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    alone = plan[plan.index("Union"):].split("Window [")[0]
    assert "LeftAnti" in alone and "Sort [" not in alone
