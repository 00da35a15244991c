import random
import zlib
from collections import Counter, defaultdict

import pytest

from acreledger.llm import queries, sharding
from acreledger.llm.sharding import pack, shard


def check(rows, out):
    assert sorted((r[0] is None, r[0] or 0, zlib.crc32((r[1] or "").encode())) for r in rows) == sorted((r.doc_id is None, r.doc_id or 0, r.text_crc32) for r in out)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
        assert r.law == "bytes" and 0 <= r.shard < 8
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = Counter()
    for r in out:
        sizes[r.shard] += r.size
    return sizes, by


def test_even_shards_with_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK_ROWS", 50)
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 60)))) for i in range(2000)] + [(5000 + i, "the hot text " * 9) for i in range(1000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, slot string, digest_ int")
    out = shard(df)
    assert out.columns == ["doc_id", "text", "digest_", "size", "text_crc32", "law", "shard", "slot"]
    sizes, by = check(rows, out.collect())
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 0.005 * sum(sizes.values()) / 8
    assert max(map(len, by.values())) <= 1.05 * min(map(len, by.values()))
    assert sorted(map(tuple, shard(df).collect())) == sorted(map(tuple, out.collect()))


def spread(values):
    return (max(values) - min(values)) * len(values) / sum(values)


@pytest.mark.parametrize("key", [7, None])
def test_copies_of_one_row_are_dealt_out(spark, monkeypatch, key):
    monkeypatch.setattr(sharding, "CHUNK_ROWS", 50)
    monkeypatch.setattr(sharding, "COPIES", 300)
    rng = random.Random(5)
    rows = [(i + 10, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 60)))) for i in range(4000)]
    rows += [(key, "the same row " * 9)] * 4000
    df = spark.createDataFrame([(*r, {"a": 1}, "x") for r in rows], "doc_id long, text string, more map<string,int>, who_ string").repartition(5)
    out = shard(df)
    assert out.columns[:4] == ["doc_id", "text", "more", "who_"]
    got = out.collect()
    sizes, by = check(rows, got)
    assert len(sizes) == 8 and spread(list(sizes.values())) <= 0.005
    assert spread([len(s) for s in by.values()]) <= 0.05
    again = shard(df.drop("more").repartition(3)).collect()
    assert Counter((r.doc_id, r.text, r.shard) for r in again).keys() and check(rows, again)


def test_rows_alike_in_key_and_text_alone(spark):
    rows = [(1, "the same text")] * 3000 + [(i + 10, f"text {i} " * (1 + i % 40)) for i in range(3000)]
    out = shard(spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, n int"))
    got = out.collect()
    sizes, _ = check(rows, got)
    assert sorted(r.n for r in got) == list(range(6000)) and spread(list(sizes.values())) <= 0.005


@pytest.mark.parametrize("largest", [100, 1e9])
def test_packing_balances_all_dimensions(largest):
    """Long-tailed units; without a bound one is larger than a shard's share, and the other shards are even."""
    rng = random.Random(11)
    units = []
    for i in range(2000):
        size = min(largest, rng.paretovariate(1.2))
        units.append((f"u{i}", (size * rng.uniform(3, 9), size * rng.uniform(0.5, 2), float(min(60, 1 + int(rng.paretovariate(1.5)))))))
    placed = pack(units, 8)
    assert sorted(placed) == sorted(u for u, _ in units)
    for d, least in enumerate((0.005, 0.02, 0.02)):
        total = Counter()
        for name, size in units:
            total[placed[name]] += size[d]
        apart = placed[max(units, key=lambda u: u[1][0])[0]] if largest > 100 else None
        assert spread([n for s, n in total.items() if s != apart]) <= least, d


def test_odd_rows(spark):
    rows = [(None, None), (None, ""), (1, ""), (1, ""), (2, "é" * 50_000), (3, "a")]
    out = shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(rows, out)
    assert sorted(r.size for r in out) == [1, 1, 1, 1, 2, 100_001]
    assert shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equal_texts_stay_together_unless_large(spark):
    rows = [(i, f"text number {i // 2} " * 4) for i in range(4000)]
    out = shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(len({r.shard for r in out if r.text == t}) == 1 for t in {r[1] for r in rows[:60]})


def test_pack_takes_the_highest_dot_product():
    # a heavy unit of bytes, one of rows: the next unit of bytes goes where bytes are lacking
    placed = pack([("a", (60, 1)), ("b", (1, 60)), ("c", (39, 1)), ("d", (0, 38))], 2)
    assert placed["a"] != placed["c"] and pack([], 3) == {}


def test_query(spark):
    out = queries.QUERIES["op2_sharding"](spark, "/root/testdata/sf0.01")
    assert out.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    sizes = Counter()
    for r in out.collect():
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 0.01 * sum(sizes.values()) / 8
