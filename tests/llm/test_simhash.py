import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from acreledger.llm import simhash
from acreledger.llm.components import components
from acreledger.llm.simhash import classes, fingerprint_of, keep_one, links


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def plain_components(edges):
    kin = {}

    def head(x):
        while kin.setdefault(x, x) != x:
            x = kin[x]
        return x

    for a, b in edges:
        kin[max(head(a), head(b))], _ = min(head(a), head(b)), None
    return {x: head(x) for x in list(kin)}


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aB c\té\n", max_size=80))
def test_fingerprint(text):
    assert fingerprint_of(text, 3) == plain_fingerprint(text)


def test_fingerprint_of_long_text_is_whole():
    text = " ".join(f"w{i % 977}x{i % 31}" for i in range(13_000))
    assert fingerprint_of(text, 3) == plain_fingerprint(text)


def close(prints, bits=3):
    return {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= bits}


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_links_are_all_close_pairs(spark, bits):
    import random

    rng = random.Random(4)
    prints = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        prints |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(30)}
    prints = [p - (1 << 64) if p >> 63 else p for p in prints] + [0, -1, 1]
    df = spark.createDataFrame([(p,) for p in prints + prints[:5]] + [(None,)], "p long")
    got = links(df, "p", bits).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == close(set(prints), bits)


def test_components(spark):
    import random

    rng = random.Random(1)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, 5001 + i) for i in range(300)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = {k: v for k, v in plain_components(edges).items() if any(x != y for x, y in edges if k in (x, y))}
    assert {r.node: r.component for r in components(df).collect()} == want
    assert components(df.limit(0)).count() == 0


TEXT = " ".join(f"word{i}" for i in range(300))
ROWS = [
    (7, TEXT), (3, TEXT), (3, TEXT), (9, TEXT.replace("word150", "other")), (None, TEXT), (20, None), (21, ""), (22, " \t\n"), (None, None),
    (30, "a b"), (31, "A  b"), (40, "entirely different words stand in here today"), (None, "alone by itself and unlike the others here")]


def test_classes_and_keep_one(spark):
    df = spark.createDataFrame([(*r, "x", "y") for r in ROWS], "doc_id long, text string, simhash string, component string")
    got = classes(df).collect()
    prints = {t: plain_fingerprint(t) for _, t in ROWS}
    edges = close(set(prints.values()))
    heads = plain_components(edges)
    group = lambda t: heads.get(prints[t], prints[t])
    least = {}
    for k, t in ROWS:
        least[group(t)] = min((x for x in (k, least.get(group(t))) if x is not None), default=None)
    assert sorted(map(tuple, got), key=repr) == sorted(((k, prints[t], least[group(t)]) for k, t in ROWS), key=repr)
    kept = keep_one(df)
    assert kept.columns == df.columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(found) == len(least) == len({group(t) for _, t in found})
    assert {least[group(t)] for _, t in found} == {k for k, _ in found}
    assert keep_one(df.limit(0)).count() == 0 and classes(df.limit(0)).count() == 0


def test_exploded_sides_are_not_broadcast(spark, monkeypatch):
    """Spark sizes them by the fingerprints before they are exploded, 4 and 68 times too low."""
    seen = []
    monkeypatch.setattr(simhash, "components", lambda df: seen.append(df) or components(df))
    df = spark.createDataFrame([(i, f"w{i} x{i % 7} y{i % 3} and a few words more") for i in range(300)], "doc_id long, text string")
    assert classes(df).count() == 300 and keep_one(df).count() > 0
    assert len(seen) == 2
    for found in seen:
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "BroadcastExchange" not in plan
