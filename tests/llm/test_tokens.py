import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparlance.llm import tokens

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def codec():
    with open(tokens.DEFAULT_VOCABULARY, "rb") as f:
        return tokens.Codec(f.read(), 16)


PARTS = st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "'s", "'", "'re", "é", "漢字", "😀", "12", "..", "\t", "ing", "zzzz", "<|endoftext|>", " x", "​", "́", "\r\n", "0"]), max_size=120)


@settings(max_examples=300, deadline=None)
@given(PARTS, st.integers(2, 40))
def test_tree_equals_plain(codec, parts, leaf):
    text = "".join(parts)
    codec.leaf = leaf
    assert codec.encode(text) == codec.encoding.encode_ordinary(text)
    assert codec.decode(codec.encode(text)).decode() == text


def test_long_single_pieces(codec):
    codec.leaf = 32
    rng = random.Random(2)
    for alphabet in ("ab", "e", "aeiourstn", "漢字仮名", "=-", "0123456789", " "):
        text = "".join(rng.choice(alphabet) for _ in range(6000))
        assert codec.encode(text) == codec.encoding.encode_ordinary(text)


def test_same_ids_as_the_other_library(codec):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = ["SELECT name FROM t WHERE x = 'O''Neil';", "Straße – 12 € 👍🏽\n\n  a", "<|endoftext|> x", "﻿​я́"]
    codec.leaf = 5
    assert [codec.encode(x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


SCHEMA = "doc_id long, text string, key string, ids string, part int, row int"


def test_frames(spark, codec):
    big = (1 << 60) + 1
    texts = [(big, "Hello  world"), (2, ""), (3, None), (None, "a b"), (5, "word " * 3000), (6, "x" * 9000), (7, "line one\n" * 700 + "é" * 800), (2, "")]
    df = spark.createDataFrame([(k, t, "k", "i", 1, 2) for k, t in texts], SCHEMA)
    for spread in (1 << 20, 1000):
        out = tokens.encode_texts(df, leaf=64, spread=spread).collect()
        got = sorted((str(r["doc_id"]), r["ids"]) for r in out)
        assert got == sorted((str(k), codec.encoding.encode_ordinary(t) if t else []) for k, t in texts)
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(df).collect()}
    assert counts[3] == 0 and counts[2] == 0 and counts[5] == len(codec.encoding.encode_ordinary("word " * 3000))
    assert tokens.encode_texts(df.limit(0)).count() == 0
