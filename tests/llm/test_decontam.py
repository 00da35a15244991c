import os
import random
import re

import duckdb
import pytest

from acreledger.llm import queries
from acreledger.llm.decontam import Items, decontaminate, find, merged, scan, shards


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=13):
    w = words(text)
    hit, ids, longest = set(), set(), 0
    for item, t in items:
        v = words(t)
        if item is None or not v:
            continue
        n = min(window, len(v))
        for i in range(len(v) - n + 1):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[i : i + n]:
                    hit |= set(range(p, p + n))
                    ids.add(str(item))
                    m = n
                    while p + m < len(w) and i + m < len(v) and w[p + m] == v[i + m]:
                        m += 1
                    longest = max(longest, m)
    return len(w), len(hit), sorted(ids), longest


def random_case(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "C", "é", "x1"][: rng.randint(1, 5)]
    make = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ".", " -"]) for _ in range(rng.randint(0, n)))
    items = [(str(i % 7), make(12)) for i in range(9)] + [("q", ""), ("z", "...")]
    texts = [make(60) for _ in range(12)] + ["", None, items[0][1], "zz " + items[1][1] + " zz"]
    return texts, items


@pytest.mark.parametrize("seed", range(30))
def test_scan_as_brute_force(seed):
    texts, items = random_case(seed)
    for window in (3, 5):
        got = scan(texts, Items.number(items, window))
        for (n, spans, ids, longest, _), text in zip(got, texts, strict=True):
            hit = sum(b - a for a, b in zip(spans[::2], spans[1::2], strict=True))
            assert (n, hit, ids, longest) == brute(text, items, window)


def test_shards_keep_documents_whole():
    texts = ["a " * 5, "b " * 30, None, "c", "d " * 9]
    parts = list(shards(texts, 10))
    assert [len(d) for part, _ in parts for d in part] == [5, 30, 0, 1, 9]
    assert merged([(3, 5), (5, 7), (9, 10), (4, 6)]) == [3, 7, 9, 10]


def test_find_in_blocks(spark, monkeypatch):
    texts, items = random_case(99)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_hit int, state_ string")
    bench = spark.createDataFrame([*items, (None, "a b c"), ("9", None), items[0]], "item_id string, text string")
    whole = [tuple(r) for r in find(docs, bench, window=4).orderBy("doc_id").collect()]
    monkeypatch.setattr("acreledger.llm.decontam.blocks", lambda *a: iter([items[:4], items[4:]]))
    assert [tuple(r) for r in find(docs, bench, window=4).orderBy("doc_id").collect()] == whole
    for row, text in zip(whole, texts, strict=True):
        assert (row[3], row[5], row[6], row[7]) == brute(text, items, 4)
    monkeypatch.undo()
    kept = decontaminate(docs, bench, window=4)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, t in enumerate(texts) if not 0 < len(words(t)) <= 20 * brute(t, items, 4)[1]}
    assert decontaminate(docs, bench.limit(0)).count() == len(texts) and find(docs.limit(0), bench).count() == 0


def test_query_as_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.QUERIES["op6_decontamination"](spark, sf)
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(sf, name)}.parquet'")
    want = con.execute(queries.ORACLES["op6_decontamination"])
    assert got.columns == [d[0] for d in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
