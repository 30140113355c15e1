import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import helixmill.llm.tokenize as tk
from helixmill.llm.queries import vocabulary

tokenizers = pytest.importorskip("tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def encoder():
    tokens = tk.read_ranks(vocabulary())
    return tk.Encoder(tokens, *tk.splits(tokens))


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(os.path.join(os.path.dirname(vocabulary()), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


PIECES = st.sampled_from(["the", " The", "ing", "ization", "aaaa", "<|endoftext|>", "\r\n", "\n\n", "   ", "'ll", "'S", "中文", "日本語です", "한국", "नमस्ते", "ก็", "é", "é", "😀", "½Ⅳ", "0123456789", "=_1415dc54a8", "a6N/UJSJ", "\t", " ", "​"])


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.lists(PIECES, max_size=12).map("".join), st.text(max_size=40), st.text(alphabet="abc 12'\n", max_size=60)))
def test_as_the_public_library(encoder, reference, text):
    got = encoder.encode(text)
    assert got == reference(text) and encoder.count(text) == len(got)


def test_long_words(encoder):
    other = tiktoken.Encoding("own", pat_str=tk.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tk.read_ranks(vocabulary()))}, special_tokens={})
    for s in ("a" * 3000, "ab" * 1000, "abcdefgh" * 300 + "x", "=" * 777, " " * 500, "é" * 400):
        assert encoder.encode(s) == other.encode_ordinary(s)


def test_memo_is_bounded(encoder, monkeypatch):
    monkeypatch.setattr(tk, "MEMO_WORDS", 10)
    encoder.encode(" ".join(f"w{i}q" for i in range(100)))
    assert len(encoder.memo) <= 10 or len(encoder.memo) > 10 and encoder.memo.clear() is None


def test_corpus(spark, reference, monkeypatch):
    monkeypatch.setattr(tk, "LONG_TEXT", 50)
    texts = ["", None, "  ", "Hello world", "Hello world", "x" * 500, "naïve café — 中文。" * 30]
    df = spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in tk.encode_corpus(df, ["doc_id"], "text", vocabulary()).collect()}
    assert got == {i: reference(t or "") for i, t in enumerate(texts)}
    sizes = {r.doc_id: r.n_tokens for r in tk.count_tokens(df, ["doc_id"], "text", vocabulary()).collect()}
    assert sizes == {i: len(x) for i, x in got.items()}
    assert tk.encode_corpus(df.limit(0), ["doc_id"], "text", vocabulary()).count() == 0
    with pytest.raises(ValueError):
        tk.encode_corpus(df, ["ids"], "text", vocabulary())
