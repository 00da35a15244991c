import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from acreledger.llm.pieces import Codec, PieceModel, encode, encode_digests

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = PieceModel.load(PATH)
CODEC = Codec(MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = ["", " ", "  ", "a  b", " a\n\nb\t c", "▁", "▁▁ a", "x▁y", "日本語 text", "é́", "\x00a", "<s> </s> <unk>", "<0x41>", "😀 😀", "a" * 400, "ab" * 300, "{\r\n\t\t});\r\n", "1234567 8,9", "Ünïcödé wörds"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_as_the_library(text):
    ids = LIBRARY.encode(text, add_eos=True)
    assert CODEC.encode(text) == ids
    assert CODEC.decode(ids) == LIBRARY.decode(ids) == CODEC.written(text)[1]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdetheing  \n▁é<>0x1"), st.characters(codec="utf-8")), max_size=60))
def test_any_text_as_the_library(text):
    ids = LIBRARY.encode(text, add_eos=True)
    assert CODEC.encode(text) == ids
    assert CODEC.written(text)[1] == LIBRARY.decode(ids)


def test_pair_checks_as_plain_merging():
    pieces = sorted((p for p in CODEC.ids if len(p) <= 6), key=lambda p: hashlib.md5(p.encode()).digest())
    for left, right in zip(pieces[:4000], pieces[4000:8000]):
        if CODEC.made(left):
            assert CODEC.fits(left, right) == (CODEC.merges(left + right)[0] == [left, right])


def test_frame(spark, rows):
    texts = [None, *ODD, ODD[3]]
    df = spark.createDataFrame([(i % 5 if i % 7 else None, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, IDS string")
    got = encode(df, PATH).select("doc_id", "ids", "decoded").collect()
    assert sorted((list(r.ids), r.decoded) for r in got) == sorted((LIBRARY.encode(t or "", add_eos=True), LIBRARY.decode(LIBRARY.encode(t or ""))) for t in texts)
    digests = encode_digests(df, PATH)
    assert digests.columns == ["doc_id", "text", "IDS", "n_tokens", "ids_sha256", "decoded_sha256"]
    row = digests.filter("text = 'a  b'").first()
    ids = LIBRARY.encode("a  b", add_eos=True)
    assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert encode(df.limit(0), PATH).count() == 0
