import numpy as np
import pytest

from acreledger.llm import langid, quality, queries, toxicity
from acreledger.llm.common import bounded_sample, distinct_sample, fair_shares

SF = "/root/testdata/sf0.01"
ODD = [(None, None, None), (1, "", "en"), (2, None, "de"), (3, "123 !!", None), (4, "é" * 70_000, "fr"), (4, "é" * 70_000, "fr"), (5, "ab", "en")]


def brute_spectrum(text):
    out, last = [], " "
    for c in text.lower():
        c = c if c.isalpha() else " "
        if c != " " or last != " ":
            out.append(c)
        last = c
    t = " " + "".join(out).strip() + " "
    return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} - {" "} if t.strip() else set()


def test_kernel_counts_shared_ngrams():
    texts = ["The cat, the hat", "a  cat sat!", "Été à Paris", "", "x"]
    signs = langid.alphabet(texts)
    for t in texts:
        grams = langid.spectrum(t, signs)
        assert len(set(grams.tolist())) == len(brute_spectrum(t))
    place, z = langid.landmark_columns(texts[:3], signs)
    model = langid.Model(("a",), signs, place, np.ones((z.shape[1], 1), dtype=np.float32))
    shared = model.presence(texts) @ z.T
    for i, t in enumerate(texts):
        for j, u in enumerate(texts[:3]):
            assert shared[i, j] == len(brute_spectrum(t) & brute_spectrum(u))


def test_folded_weights_are_the_ridge_regression():
    rng = np.random.default_rng(0)
    z = (rng.random((12, 60)) < 0.4).astype(np.float32)
    x = (rng.random((50, 60)) < 0.4).astype(np.float32)
    size = lambda m: np.sqrt(m.sum(axis=1, keepdims=True))
    y = np.arange(50) % 2
    kernel = (x @ z.T) / size(x) / size(z).T
    own = (z @ z.T) / size(z) / size(z).T
    weights = langid.solve(z, kernel, y, 2, 0.1)
    # the same regression in its dual form over the landmarks
    target = (y[:, None] == np.arange(2)).astype(float)
    alpha = np.linalg.solve(kernel.T @ kernel + 0.1 * own, kernel.T @ target)
    assert np.allclose((x @ weights) / size(x), kernel @ alpha, atol=1e-3)


def test_language_held_out_accuracy(spark):
    got = queries.QUERIES["op4_language_id"](spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = [r for r in got.join(docs, "doc_id").collect() if r.held_out]
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark):
    docs = spark.createDataFrame([(*r, 0.5) for r in ODD], "doc_id long, text string, lang string, score double")
    model = langid.fit(docs, ~langid.held_out_fold())
    got = langid.predict(docs, model).collect()
    assert [r.lang_pred for r in got if not r.text or r.text == "123 !!"] == ["und"] * 4
    kept = langid.accept(docs, model)
    assert kept.columns == docs.columns and kept.count() <= 3
    none = langid.fit(docs.limit(0), ~langid.held_out_fold())
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


@pytest.mark.parametrize(("name", "label", "least"), [("op7_toxicity", "toxic", 0.9), ("op8_quality", "quality", 0.95)])
def test_labels_held_out_accuracy(spark, name, label, least):
    got = queries.QUERIES[name](spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = [r for r in got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect() if r.held_out]
    assert len(rows) > 60 and sum(r[label] == r.predicted for r in rows) >= least * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_grammar_scores_clauses():
    lexicon = toxicity.Lexicon({"moron": 4.0, "mormon": 0.0}, {"mor": 2.0}, (3,))
    scorer = toxicity.Scorer(lexicon, None)
    kinds = lambda t: [m[1] for _, ms in scorer.clauses(t)[0] for m in ms]
    weight = lambda t: sum(s for s, _ in scorer.clauses(t)[0])
    assert kinds("a moron here") == ["insult"] and kinds("You moron") == ["insultg"]
    assert kinds("he is not a moron") == ["insultgn"] and kinds("paper said: x") == []
    assert kinds("the paper said moron") == ["insultr"] and kinds("we kill time") == [] and kinds("you, we kill") == ["threatg"]
    assert kinds("you. what a moron") == ["insult"]  # the target stands in another clause
    assert weight("you moron") > weight("a moron") > weight("said a moron") > weight("said not a moron") > 0
    assert kinds("mormon") == [] and kinds("morxyz") == ["insult"] and kinds(None) == [] == kinds("")


def test_lexicon_counts_a_copied_passage_once():
    own = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(60)]
    copies = [f"x{i} so the quick foxword went home y{i}" for i in own[:20]]
    insults = [f"a{i} b{i} grobian c{i} d{i}" for i in own[:12]]
    clean = [f"a{i} b{i} c{i} went home d{i}" for i in own]
    lexicon = toxicity.learn_lexicon(copies + insults + clean, [1] * 32 + [0] * 60)
    assert lexicon.weight("grobian") > 0 and lexicon.weight("foxword") == 0 and lexicon.weight("home") == 0


def brute_features(text):
    words = text.encode().split()
    grams = set()
    for w in words:
        padded = b" " + w + b" "
        grams |= {padded[i : i + n] for n in quality.ORDERS for i in range(len(padded) - n + 1)}
    return words, grams


def test_subword_features_are_word_local():
    text = "Ab, cd\n ab  é&&& &&& Ab, Ab,"
    words, grams = brute_features(text)
    found = quality.features(text.encode())
    assert len(found[0]) == len(words) and len(set(found[0].tolist())) == len(set(words))
    assert len(found[1]) == len(words) - 1
    assert len(set(np.concatenate(found[2:]).tolist())) == len({g for g in grams})
    assert [len(f) for f in quality.features(b" \n")] == [0] * 5


@pytest.mark.parametrize("piece", [3, 7, 64, 500])
def test_quality_features_go_on_over_pieces(monkeypatch, piece):
    odds = np.random.default_rng(1).normal(size=quality.BUCKETS).astype(np.float32)
    for text in (" ".join(f"word{i % 91}" for i in range(400)), "x" * 3000, "a  b\n\n" * 200, "é ü" * 300 + " ", "", "a"):
        monkeypatch.setattr(quality, "PIECE", 1 << 20)
        whole, score = quality.features(text.encode()), quality.score_text(odds, 0.1, text)
        monkeypatch.setattr(quality, "PIECE", piece)
        for a, b in zip(whole, quality.features(text.encode()), strict=True):
            assert a.tolist() == b.tolist()
        assert abs(quality.score_text(odds, 0.1, text) - score) < 1e-9
    assert quality.score_text(odds, 0.0, None) == quality.score_text(odds, 0.0, "") == 0.5


def test_quality_of_a_text_of_several_megabytes():
    odds = np.random.default_rng(1).normal(size=quality.BUCKETS).astype(np.float32)
    assert 0 <= quality.score_text(odds, 0.0, "y" * 5_000_000) <= 1
    unit = "some words of prose, then "
    assert abs(quality.score_text(odds, 0.0, unit * 200_000) - quality.score_text(odds, 0.0, unit * 20_000)) < 1e-3


@pytest.mark.parametrize("module", [toxicity, quality])
def test_labelled_odd_rows(spark, module):
    docs = spark.createDataFrame([(*r, 9) for r in ODD] + [(i, f"fine words {i}", "en", 1) for i in range(20, 60)], "doc_id long, text string, lang string, PREDICTED int")
    label = "toxic" if module is toxicity else "quality"
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None), (4, 7), (4, 1), (999, 1)], f"doc_id long, {label} int")
    model = module.fit(docs, labels, ~module.held_out_fold())
    got = module.score(docs, model)
    assert got.columns[:3] == ["doc_id", "text", "lang"] and "predicted" in got.columns and "PREDICTED" not in got.columns
    assert got.count() == docs.count() and all(0 <= r.score <= 1 for r in got.collect())
    assert module.score(docs.limit(0), model).count() == 0
    unlearned = module.score(docs, module.fit(docs, labels.limit(0), ~module.held_out_fold())).collect()
    assert len({r.score for r in unlearned}) == 1
    if module is toxicity:
        assert module.accept(docs, model).columns == docs.columns


def test_bounded_sample(spark):
    df = spark.range(500).selectExpr("id", "id % 3 AS same")
    assert bounded_sample(df, ["id"], 100).count() == 100
    assert bounded_sample(df, ["same"], 100).count() == 0 and bounded_sample(df, ["id"], 500).count() == 500


def test_copies_never_empty_the_sample(spark):
    rows = [(i, "the cat sat on the mat", "en") for i in range(200)] + [(200 + i, f"der hund {chr(97 + i)} und die katze", "de") for i in range(20)] + [(220 + i, f"the dog {chr(97 + i)} and the cat", "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    pairs = distinct_sample(docs, ["text", "lang"], "lang", 10)
    assert len(set(pairs)) == 10 and [g for g, _ in pairs] == ["de"] * 5 + ["en"] * 5
    every = docs.selectExpr("lang", "xxhash64(text, lang) AS h").distinct().collect()
    assert pairs == sorted(x for g in ("de", "en") for x in sorted((r.lang, r.h) for r in every if r.lang == g)[:5])
    model = langid.fit(docs, langid.F.lit(True), sample_rows=10)
    assert model.languages == ("de", "en")
    assert [x[0] for x in model.predict(["the cat and the dog", "die katze und der hund"])] == ["en", "de"]
    assert fair_shares({"a": 2, "b": 100, "c": 50}, 30) == {"a": 2, "b": 14, "c": 14} and fair_shares({}, 3) == {}


def test_letters_of_all_scripts_stay_distinct():
    blocks = {"en": 97, "ru": 0x430, "ko": 0xAC00, "th": 0xE01, "zh": 0x4E00}
    texts = {k: " ".join("".join(chr(first + (i * 7 + j * 3) % 26) for j in range(5)) for i in range(40)) for k, first in blocks.items()}
    signs = langid.alphabet(list(texts.values()))
    for t in texts.values():
        assert len(set(langid.spectrum(t, signs).tolist())) == len(brute_spectrum(t))
    place, z = langid.landmark_columns(list(texts.values()), signs)
    model = langid.Model(tuple(texts), signs, place, np.ones((z.shape[1], 1), dtype=np.float32))
    shared = model.presence(list(texts.values())) @ z.T
    for i, t in enumerate(texts.values()):
        for j, u in enumerate(texts.values()):
            assert shared[i, j] == len(brute_spectrum(t) & brute_spectrum(u))


def test_scripts_beyond_62_letters_are_told_apart(spark):
    rng = np.random.default_rng(3)
    first = {"en": 97, "ru": 0x430, "ko": 0xAC00, "th": 0xE01, "zh": 0x4E00}
    text = lambda lang: " ".join("".join(chr(first[lang] + int(x)) for x in rng.integers(0, 26, 4)) for _ in range(30))
    rows = [(5 * i + n, text(lang), lang) for i in range(12) for n, lang in enumerate(first)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, langid.F.lit(True))
    assert [x[0] for x in model.predict([text(lang) for lang in first])] == list(first)


def test_columns_by_hash_are_columns_by_search():
    rng = np.random.default_rng(5)
    grams = np.unique(rng.integers(0, 1 << 62, 5000))
    place = langid.Places(grams)
    asked = np.r_[grams, rng.integers(0, 1 << 62, 5000)]
    known = set(grams.tolist())
    assert (place.table == -2).any()
    assert place[asked].tolist() == [int(np.searchsorted(grams, g)) if g in known else len(grams) for g in asked.tolist()]
    assert langid.fitting([("a", "ab"), ("a", "cd"), ("b", "ef"), ("b", "ab")], langid.alphabet(["abcdef"]), 8) == ["ab", "ef"]


def test_grammar_finds_targets_on_both_sides():
    scorer = toxicity.Scorer(toxicity.Lexicon({"idiot": 4.0}, {}, ()), None)
    kinds = lambda t: [m[1] for _, ms in scorer.clauses(t)[0] for m in ms]
    weight = lambda t: sum(s for s, _ in scorer.clauses(t)[0])
    for threat in ("I will kill you", "hurt them", "destroy you", "we will not rest but burn the house of them"):
        assert [k[:7] for k in kinds(threat)] == ["threatg"]
        assert scorer.features(threat) > scorer.features("we walk with you")
    assert kinds("idiot, you") == ["insultg"] and weight("idiot, you") == weight("you idiot") == weight("you idiot, you") > weight("idiot")
    assert kinds("kill time. you") == kinds("kill a b c d you") == [] and kinds("kill a b c you") == ["threatg"]
    assert kinds("never hurt them") == ["threatgn"]
