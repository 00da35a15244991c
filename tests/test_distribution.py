"""Exact order statistics against brute force, on skewed and awkward groups."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from acreledger.operators.distribution import coarse, group_ranks, percentiles, value_ranks


def interpolate(values, p):
    values = sorted(values)
    k = (len(values) - 1) * p
    lo = math.floor(k)
    hi = math.ceil(k)
    return values[lo] + (k - lo) * (values[hi] - values[lo])


def skewed():
    rng = random.Random(7)
    out = []
    for i in range(4000):
        group = "hot" if i % 3 == 0 else f"g{rng.randrange(40)}"
        value = 5.0 if group == "hot" and rng.random() < 0.7 else rng.choice([rng.expovariate(0.01), -rng.expovariate(0.01), 0.0])
        out.append((i, group, value))
    out += [(9001, None, 3.5), (9002, None, 4.5), (9003, "nulls", None), (9004, "one", 42.0)]
    return out


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(skewed(), "id long, grp string, v double")


def groups():
    out = {}
    for _, g, v in skewed():
        if v is not None:
            out.setdefault(g, []).append(v)
    return out


def test_percentiles_match_brute_force(frame):
    ps = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {r["grp"]: r for r in percentiles(frame, ["grp"], "v", ps).collect()}
    want = groups()
    assert set(got) == set(want)
    for g, values in want.items():
        for name, p in ps.items():
            assert got[g][name] == pytest.approx(interpolate(values, p), rel=1e-12, abs=1e-12), (g, name)


def test_percentiles_without_keys(frame):
    got = percentiles(frame, [], "v", {"p50": 0.5}).collect()
    every = [v for values in groups().values() for v in values]
    assert len(got) == 1 and got[0]["p50"] == pytest.approx(interpolate(every, 0.5))


def test_upper_median(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(4)] + [("b", 9.0)], "g string, v double")
    got = {r["g"]: r["m"] for r in percentiles(df, ["g"], "v", {"m": 0.5}, discrete_upper=True).collect()}
    assert got == {"a": 2.0, "b": 9.0}


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([("a", None)], "g string, v double")
    assert percentiles(df, ["g"], "v", {"p50": 0.5}).count() == 0


def test_group_ranks_number_every_row_once(frame):
    rows = group_ranks(frame.where("v IS NOT NULL"), ["grp"], "v", "id", salts=8).collect()
    by = {}
    for r in rows:
        by.setdefault(r["grp"], []).append((r["rank_no"], r["v"], r["group_n"]))
    for g, values in groups().items():
        seen = sorted(by[g])
        assert [n for n, _, _ in seen] == list(range(1, len(values) + 1))
        assert [v for _, v, _ in seen] == sorted(values)
        assert {n for _, _, n in seen} == {len(values)}


def test_value_ranks_match_window_rank(frame):
    from pyspark.sql import Window

    want = frame.withColumn("rnk", F.rank().over(Window.partitionBy("grp").orderBy(F.desc("v"))))
    got = value_ranks(frame, ["grp"], "v")
    assert sorted(map(tuple, got.select("id", "rnk").collect())) == sorted(map(tuple, want.select("id", "rnk").collect()))


@settings(max_examples=12, deadline=None)
@given(st.lists(st.floats(min_value=-1e12, max_value=1e12, allow_nan=False), min_size=2, max_size=60))
def test_coarse_is_monotone(spark, values):
    extra = [10.0**k for k in range(-3, 7)] + [math.nextafter(10.0**k, 0) for k in range(-3, 7)]
    df = spark.createDataFrame([(v,) for v in sorted(values + extra)], "v double")
    cut = [r["c"] for r in df.select("v", coarse(F.col("v")).alias("c")).orderBy("v").collect()]
    assert cut == sorted(cut)


def test_narrow_values_part_over_buckets(spark, monkeypatch):
    """Thousands of values within a millionth of each other, around both signs, and clusters inside clusters: bit-exact, no full bucket."""
    from acreledger.operators import distribution

    monkeypatch.setattr(distribution, "BUCKET_ROWS", 50)
    rng = random.Random(3)
    values = {"narrow": [1.5 + rng.random() * 1e-6 for _ in range(3000)], "negative": [-7.25 - rng.random() * 1e-6 for _ in range(500)],
              "nested": [2.0 + rng.random() * 10.0 ** -rng.randint(5, 15) for _ in range(2000)], "spike": [3.0] * 4000 + [3.0 + 1e-9 * i for i in range(200)], "zero": [-0.0, 0.0, 5e-324] * 30}
    rows = [(i, g, v) for i, (g, v) in enumerate((g, v) for g, vs in values.items() for v in vs)]
    df = spark.createDataFrame(rows, "id long, grp string, v double")
    units = distribution.refined(distribution.value_counts(df, ["grp"], "v"), ["grp"])
    sizes = units.groupBy("grp", "__b").agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi")).collect()
    assert all(r["n"] <= 50 or r["lo"] == r["hi"] for r in sizes)
    for g in values:  # buckets keep the order of the values
        spans = sorted((r["__b"], r["lo"], r["hi"]) for r in sizes if r["grp"] == g)
        assert all(a[2] < b[1] for a, b in zip(spans, spans[1:]))
    ps = {"p05": 0.05, "p50": 0.5, "p99": 0.99}
    for r in percentiles(df, ["grp"], "v", ps).collect():
        assert all(r[n] == interpolate(values[r["grp"]], p) for n, p in ps.items())
    ranks = group_ranks(df, ["grp"], "v", "id").collect()
    order = sorted(ranks, key=lambda r: (r["grp"], r["rank_no"]))
    want = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    assert [(r["grp"], r["v"]) for r in order] == [(g, v) for _, g, v in want]
    assert all(sorted(r["rank_no"] for r in ranks if r["grp"] == g) == list(range(1, len(vs) + 1)) for g, vs in values.items())
    seen = {(r["grp"], r["v"]): r["rnk"] for r in value_ranks(df, ["grp"], "v").collect()}
    assert all(seen[g, v] == 1 + sum(x > v for x in values[g]) for g in ("nested", "negative") for v in values[g][::50])
