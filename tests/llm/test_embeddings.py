import os

import duckdb
import numpy as np
import pytest

from acreledger.llm import embeddings, queries
from acreledger.llm.embeddings import near_duplicates


def brute(rows, cosine=0.95):
    ok = []
    for _, v in rows:
        fine = v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
        ok.append(np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float)) if fine else None)
    n = len(rows)
    kin = list(range(n))

    def head(i):
        while kin[i] != i:
            i = kin[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i):
            if ok[i] is not None and ok[j] is not None and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= cosine:
                links[i] += 1
                links[j] += 1
                kin[head(i)] = head(j)
    least = {}
    for i in range(n):
        least[head(i)] = min((x for x in (least.get(head(i)), rows[i][0]) if x is not None), default=None)
    return sorted(((rows[i][0], links[i], least[head(i)], least[head(i)] == rows[i][0]) for i in range(n)), key=repr)


def clustered(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    return [[float(x) for x in centres[rng.integers(6)] + rng.normal(size=dim) * spread] for _ in range(n)]


@pytest.mark.parametrize(("seed", "dim", "spread"), [(1, 8, 0.15), (2, 8, 0.35), (3, 3, 0.2), (4, 16, 0.22)])
def test_as_brute_force(spark, monkeypatch, seed, dim, spread):
    for name, value in (("CELL", 20), ("BLOCK", 16), ("TILE", 7)):
        monkeypatch.setattr(embeddings, name, value)
    rows = list(enumerate(clustered(seed, 220, dim, spread)))
    rows += [(1000 + i, rows[5][1]) for i in range(40)] + [(2000, None), (2001, [0.0] * dim), (2002, [float("nan")] * dim), (2003, [None] * dim), (2004, []), (2005, [1.0, 2.0]), (None, rows[7][1]), (3, rows[3][1])]
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], "vec_id long, embedding array<double>, n_links int")
    assert sorted(map(tuple, near_duplicates(df).collect()), key=repr) == brute(rows)


def test_copies_to_cells_lose_no_pair():
    rng = np.random.default_rng(5)
    x = embeddings.unit(np.array(clustered(9, 400, 6, 0.4)))
    pivots = embeddings.unit(x[rng.choice(400, 15, replace=False)])
    at, cell, own = embeddings.cells_of(x, pivots, np.sqrt(0.1))
    home = cell[:400]
    held = set(zip(at.tolist(), cell.tolist(), strict=True))
    for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.95, 1)), strict=True):
        first = min(home[i], home[j])
        assert (i, first) in held and (j, first) in held
    assert len(at) < 400 * 15 / 2 and own[:400].all() and not own[400:].any()


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_duplicates(df).collect() == []


def test_query_as_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.QUERIES["op1_embedding_near_dedup"](spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{os.path.join(sf, 'embeddings')}.parquet'")
    want = con.execute(queries.ORACLES["op1_embedding_near_dedup"])
    assert got.columns == [d[0] for d in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
