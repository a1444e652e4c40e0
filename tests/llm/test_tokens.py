from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm.tokens import Encoder, encode_column

PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def own():
    return Encoder(PATH)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_same_ids_and_round_trip(own, library, text):
    ids = own.encode_batch([text])[0]
    assert ids == library(text) and own.decode(ids) == text


@pytest.mark.parametrize("text", ["<|endoftext|>", " " * 3000, "x" * 30000, "a\x00b\r\n\n  c", "😀" * 99, "don't they'll", "日本語のテキスト"])
def test_odd_texts(own, library, text):
    ids = own.encode_batch([text])[0]
    assert ids == library(text) and own.decode(ids) == text


def test_memory_is_emptied(own, library, monkeypatch):
    from tessella.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    e = Encoder(PATH)
    texts = [f"word{i} other{i}" for i in range(20)]
    for t in texts * 2:
        assert e.encode_batch([t, t])[1] == library(t)


def test_column(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, " a", "z"), (3, " a", "z")], "k int, text string, ids2 string")
    got = [(r.k, r.ids) for r in encode_column(df, "text", PATH).orderBy("k").collect()]
    assert got == [(1, []), (2, []), (3, [257]), (3, [257])]
    assert encode_column(df.limit(0), "text", PATH).count() == 0
