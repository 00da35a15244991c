import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from acreledger.llm import mixing, queries
from acreledger.llm.mixing import mix, permuted, taken, targets, texts

DOCS = "doc_id long, text string, source string, place string, n_words int"


def words(n, name):
    return " ".join(f"{name}{i}" for i in range(n))


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)


def test_targets_share_by_weight_up_to_the_limit(spark):
    sizes = {"a": 10, "b": 1000, "B": 5, None: 400, "ä": 0}
    got = {r.source: r for r in targets(spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, size long, rows long")).collect()}
    assert [got[s].weight for s in ("B", "a", "b", "ä", None)] == [1, 2, 3, 1, 2]
    # water filling, step by step
    total, left, limit = sum(sizes.values()), dict(sizes), {s: 3.0 * n for s, n in sizes.items()}
    found = {}
    while True:
        rest, weight = total - sum(found.values()), sum(got[s].weight for s in left)
        share = {s: rest * got[s].weight / weight for s in left}
        above = [s for s in left if share[s] >= limit[s]]
        if not above:
            break
        for s in above:
            found[s] = limit[s]
            del left[s]
    assert {s: r.target for s, r in got.items()} == pytest.approx(found | share)
    assert sum(r.target for r in got.values()) == pytest.approx(total)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000])
def test_permutation(spark, size):
    seen = set()
    for key in (5, 2_147_483_600):
        rows = spark.range(size).select(F.col("id").alias("nth"), F.lit(size).cast("long").alias("size"), F.lit(key).cast("long").alias("key"))
        got = [r.nth for r in permuted(rows, "nth", "size", "key").collect()]
        assert sorted(got) == list(range(size))
        seen.add(tuple(got))
    assert size < 5 or len(seen) == 2


def test_near_targets_and_no_more_than_three_times(spark):
    rows = [(i, words(i % 97 + 1, "w"), "hot") for i in range(900)] + [(1000 + i, words(120, "v"), f"s{i % 4}") for i in range(80)] + [(2000, words(300, "u"), "tiny"), (2001, words(1, "t"), None)]
    docs = rows_of(spark, rows)
    out = taken(docs).collect()
    assert sorted((r.doc_id, r.size) for r in out) == sorted((i, len(t.split())) for i, t, _ in rows)
    assert all(0 <= r.taken <= 3 * r.size for r in out)
    source = {i: s for i, _, s in rows}
    got, aim = Counter(), {}
    for r in out:
        got[source[r.doc_id]] += r.taken
        aim[source[r.doc_id]] = r.target
    assert all(abs(got[s] - aim[s]) <= max(64, 0.02 * aim[s]) for s in aim)
    assert got["tiny"] == 900 and got[None] == 3
    assert sorted(map(tuple, taken(docs).collect())) == sorted(map(tuple, out))


def test_texts_are_the_words_of_the_documents(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 8)
    rows = [(i, words(i * 7 % 150, f"d{i}x"), "ab"[i % 2]) for i in range(60)] + [(7, "  same\ttext\n", "a")] * 3
    docs = rows_of(spark, rows)
    sources, laid, mixture = mix(docs)
    spelled = texts(docs, mixture, sources).collect()
    counts = Counter(w for r in spelled for w in r.text.split(" "))
    per = defaultdict(int)
    for r in taken(docs).collect():
        per[r.doc_id] += r.taken
    assert all(sum(counts[w] for w in re.findall(mixing.WORD, t)) == per[i] for i, t, _ in rows if i != 7)
    assert sum(counts[w] for w in ("same", "text", *(f"d7x{i}" for i in range(49)))) == per[7]
    slots = mixture.groupBy("shard", "slot").agg(F.sum("n_words").alias("n")).collect()
    assert max(r.n for r in slots) == 64 and len({r["shard"] for r in slots}) > 2 and len(slots) == sources.agg(F.sum("quota")).first()[0]
    assert max(r.n for r in mixture.groupBy("place", "block").agg(F.countDistinct("shard", "slot").alias("n")).collect()) <= 3
    # counts differ from shard to shard: they are drawn
    assert len({r.n for r in mixture.join(sources.filter("source = 'a'"), "place").groupBy("shard").agg(F.countDistinct("slot").alias("n")).collect()}) > 1


def test_odd_rows(spark, monkeypatch):
    rows = [(None, None, None), (None, None, None), (None, "a b", None), (1, "", "x"), (1, "", "x"), (2, " \t\n", "x"), (3, "a\x0bb\x0cc d", "y"), (4, words(50_000, "l"), "y")]
    rows += [(5, "the same five words here", "x")] * 3000
    monkeypatch.setattr(mixing, "RUN", 16)
    out = taken(rows_of(spark, rows)).collect()
    assert Counter((r.doc_id, r.size) for r in out) == Counter({(None, 0): 2, (None, 2): 1, (1, 0): 2, (2, 0): 1, (3, 3): 1, (4, 50_000): 1, (5, 5): 3000})
    assert all(r.taken <= 3 * r.size for r in out)
    assert taken(rows_of(spark, [])).collect() == []
    assert [tuple(r) for r in taken(rows_of(spark, [(1, None, None)])).collect()] == [(1, 0, 0, 0.0, 0)]


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got = queries.QUERIES["op12_mixing"](spark, "/root/testdata/sf0.001")
    assert got.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")]
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(queries.ORACLES["op12_mixing"]).fetchall())


def test_no_python_in_the_plan(spark):
    plan = taken(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
