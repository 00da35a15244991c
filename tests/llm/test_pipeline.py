import sys
from pathlib import Path

import sentencepiece

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
import public_tokenizers  # noqa: E402
import pytest  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import __spark_entry__  # noqa: E402
from acreledger.llm.common import table  # noqa: E402

from .test_decontam import brute  # noqa: E402
from .test_simhash import close, plain_components, plain_fingerprint  # noqa: E402

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_as_brute_force(spark):
    """Every stage's result from what the stage before kept, the two classifiers by their own queries."""
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "language_id", "simhash_near_dedup", "decontamination", "sentencepiece"]

    clean = stages["toxicity"](spark, docs, SF)
    queries = __spark_entry__.queries()
    toxic = {r.doc_id for r in queries["op7_toxicity"](spark, SF).filter("predicted = 1").collect()}
    assert ids(clean) == sorted(set(ids(docs)) - toxic) and clean.columns == docs.columns

    odd = docs.limit(2).select(*(F.lit("12 34!").alias("text") if c == "text" else F.col(c) for c in docs.columns))
    known = stages["language_id"](spark, docs.unionByName(odd), SF)
    assert known.columns == docs.columns and ids(known) == ids(docs)

    one = stages["simhash_near_dedup"](spark, docs, SF)
    rows = {r.doc_id: r.text for r in docs.collect()}
    prints = {k: plain_fingerprint(t) for k, t in rows.items()}
    heads = plain_components(close(set(prints.values())))
    least = {}
    for k, p in prints.items():
        least[heads.get(p, p)] = min(k, least.get(heads.get(p, p), k))
    assert ids(one) == sorted(least.values()) and one.columns == docs.columns

    free = stages["decontamination"](spark, docs, SF)
    items = [(str(r.item_id), r.text) for r in table(spark, SF, "benchmark").collect()]
    hit = {k: brute(t, items) for k, t in rows.items() if len(t or "") < 4000}
    got = set(ids(free))
    assert all((k in got) == (not (h[1] and 20 * h[1] >= h[0])) for k, h in hit.items()) and free.columns == docs.columns

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    coded = stages["sentencepiece"](spark, docs, SF).collect()
    assert len(coded) == len(rows)
    assert all(list(r.ids) == library.encode(rows[r.doc_id] or "", add_eos=True) and r.n_tokens == len(r.ids) for r in coded)


def test_run_applies_the_stages_in_turn(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).checkpoint()
    got = __spark_entry__.queries()["pipeline"](spark, SF)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, docs.collect()))


@pytest.mark.parametrize("at", range(5))
def test_odd_documents(spark, at):
    text = "the quick brown fox jumps over the lazy dog and runs " * 5
    rows = [(1, text, "en", "a", 3), (1, text, "en", "a", 3), (None, text, None, None, None), (2, None, None, None, None), (3, "", "en", "b", 0), (4, "x" * 200_000, "de", "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("mine")).withColumn("key", F.lit(1)).withColumn("row_", F.lit(2)).withColumn("n_hit", F.lit(3)).withColumn("simhash", F.lit(4))
    name, stage = corpus_pipeline.STAGES[at]
    out = stage(spark, docs, SF)
    kept = out.collect()
    assert len(kept) == {"toxicity": 6, "language_id": len(kept), "simhash_near_dedup": 3, "decontamination": 6, "sentencepiece": 6}[name]
    if at < 4:
        assert out.columns == docs.columns and {r.score for r in kept} == {"mine"}
    assert stage(spark, docs.limit(0), SF).count() == 0
