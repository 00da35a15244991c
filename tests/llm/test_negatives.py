import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from acreledger.llm import negatives
from acreledger.llm.negatives import hard_negatives, products

SCHEMA = "vec_id long, embedding array<double>, label long, anchor string, asked int"


def brute(rows, is_anchor, scale=256, positives=5, keep=3, low=50, high=95):
    fine = [(k, [math.floor(scale * x) for x in v], y) for k, v, y in rows if k is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, u, y in fine:
        if not is_anchor(a):
            continue
        scored = sorted((-sum(p * q for p, q in zip(u, v, strict=True)), k, z) for k, v, z in fine if k != a and len(u) == len(v))
        for s, p, _ in [x for x in scored if x[2] == y][:positives]:
            inside = [x for x in scored if x[2] != y and low * -s <= 100 * -x[0] <= high * -s][:keep]
            out += [(a, p, i + 1, k, -s, -t) for i, (t, k, _) in enumerate(inside)]
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted(map(tuple, hard_negatives(df, F.col("vec_id") % 5 == 0, **more).collect()))


def clustered(rng, n, d=8, labels=4):
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(labels)]
    return [(i, [c * rng.random() + rng.gauss(0, 0.3) for c in centres[rng.randrange(labels)]], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("size", [7, 1 << 15])
def test_equals_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", size)
    monkeypatch.setattr(negatives, "TILE", 3)
    rows = clustered(random.Random(1), 200)
    assert run(spark, rows) == brute(rows, lambda k: k % 5 == 0)
    assert run(spark, rows, positives=3, keep=7, low=20, high=100) == brute(rows, lambda k: k % 5 == 0, positives=3, keep=7, low=20, high=100)


def test_ties_repeats_and_one_hot_label(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(0, 1)) for _ in range(4)], 1 if rng.random() < 0.7 else rng.randint(2, 3)) for i in range(150)]
    rows += [(500 + i, [1.0, 1.0, 1.0, 0.0], 1) for i in range(60)] + [rows[10], rows[10], rows[11]]
    assert run(spark, rows) == brute(rows, lambda k: k % 5 == 0)


def test_odd_rows(spark):
    fine = clustered(random.Random(3), 40, d=3)
    odd = [(None, [1.0, 2.0, 3.0], 1), (100, None, 1), (105, [1.0, None, 0.0], 1), (110, [math.nan, 1.0, 1.0], 2), (115, [math.inf, 1.0, 1.0], 2), (120, [1.0, 1.0, 1.0], None), (125, [], 1), (126, [], 1), (127, [], 2), (130, [1.0] * 5, 1), (131, [1.0] * 5, 1), (132, [0.9] * 5, 2), (135, [-1.0, -1.0], 7), (136, [1.0, 1.0], 7), (137, [-1.0, -1.0], 8)]
    assert run(spark, fine + odd) == brute(fine + odd, lambda k: k % 5 == 0)
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0], 1)]) == []


def test_products_are_exact_beyond_doubles():
    a, b = np.array([[2.0**40, 3.0], [2.0**62, 0.0]]), np.array([[2.0**20, 1.0], [2.0**62, 1.0]])
    assert products(a, b).tolist() == [[2**60 + 3, negatives.MOST], [negatives.MOST, negatives.MOST]]
