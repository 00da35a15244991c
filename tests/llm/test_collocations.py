import random
import re
from collections import Counter, defaultdict

import pytest

from acreledger.llm import collocations as module
from acreledger.llm import queries
from acreledger.llm.collocations import collocations, phrase_counts

DOCS = "text string, lang string, phrase int, n string"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def counts_of(rows, words):
    f = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", lowered(text)):
            found = re.findall(r"[^ \t]+", piece)
            for k in range(1, words + 1):
                f[lang or "und"].update(tuple(found[i : i + k]) for i in range(len(found) - k + 1))
    return f


def brute(rows, words=3, least=10, share=50, top=2000):
    out = []
    for lang, f in counts_of(rows, words).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        kept = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * c >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, c in found.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS).repartition(parts)


def made_up(rng, n, vocabulary, length=40):
    signs = [" "] * 12 + [", ", ".\n", "\t", "  ", "!", "\x0b", " ", " - "]
    return [("".join(rng.choice(vocabulary) + rng.choice(signs) for _ in range(rng.randint(0, length))), rng.choice(["en", "de", None, "und"])) for _ in range(n)]


@pytest.mark.parametrize("words,least,share,top", [(3, 10, 50, 2000), (2, 5, 50, 7), (4, 4, 80, 30), (3, 2, 10, 5)])
def test_equals_brute_force(spark, monkeypatch, words, least, share, top):
    monkeypatch.setattr(module, "POSITIONS", 300)
    monkeypatch.setattr(module, "SLICE", 50)
    rows = made_up(random.Random(words), 200, ["a", "b", "A", "the", "The", "ß", "É", "of", "x.y", "1,2", "日本"])
    got = collocations(frame(spark, rows), words=words, least=least, share=share, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, words, least, share, top)


def test_hot_prefix_is_cut_and_counts_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(module, "POSITIONS", 1000)
    rng = random.Random(5)
    rows = [(" ".join(f"of the w{rng.randint(0, 60)}" for _ in range(50)), "en") for _ in range(100)] + [("z z z z z z z " * 20, "en")] * 30
    parts, buckets = module.plan(frame(spark, rows).select("lang", "text"), 3)
    assert parts["en"]["of the"] > 1 and buckets >= module.SAMPLE_BUCKETS
    assert sorted(map(tuple, collocations(frame(spark, rows)).collect())) == brute(rows)
    got = {(r.lang, r.phrase): r.f for r in phrase_counts(frame(spark, rows)).filter("words > 0").collect()}
    assert got == {("en", " ".join(p)): c for p, c in counts_of(rows, 3)["en"].items() if c >= 10}


def test_odd_rows(spark):
    rows = [(None, "en"), ("", None), (" \t.\n", "en"), ("one two three", "en"), ("\x00 \x1f " * 30, None)] + [("Same text, same Text", None)] * 12
    assert sorted(map(tuple, collocations(frame(spark, rows)).collect())) == brute(rows)
    assert collocations(frame(spark, [], 1)).collect() == []
    assert collocations(frame(spark, [("a", "en")], 1)).collect() == []


def test_a_very_long_text(spark):
    rng = random.Random(9)
    rows = [(" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(400_000)), "en"), ("x" * 3_000_000, "en")]
    assert sorted(map(tuple, collocations(frame(spark, rows, 1), top=50).collect())) == brute(rows, top=50)


def test_exact_scores(spark):
    counts = spark.createDataFrame([("en", "p", 1, 999_999_999_998), ("en", "q", 1, 999_999_999_999), ("en", "p q", 2, 999_999_999_997), ("en", "", 0, 10**13)], "lang string, phrase string, words int, f long")
    original, module.phrase_counts = module.phrase_counts, lambda *_: counts
    try:
        got = collocations(frame(spark, [], 1)).collect()
    finally:
        module.phrase_counts = original
    assert [r.score for r in got] == [1_000_000 * 999_999_999_997**2 // (999_999_999_998 * 999_999_999_999)]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang")
    got = queries.QUERIES["op13_collocations"](spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect())) == brute([tuple(r) for r in docs.collect()])
