from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapewell.llm import tokens

PATH = f"{tokens.DEFAULT_FOLDER}/byte_bpe_50k.tiktoken"
TEXTS = ["", None, " ", "Hello world", "naïve café 🏦👩‍💻 株価", "a" * 5000, "\n\n  x\t\ty ", "don't we'll", "<|endoftext|>", "١٢٣ ½", "x " * 3000]


@pytest.fixture(scope="module")
def other():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.DEFAULT_FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids_as_the_other_library(other, text):
    assert tokens.encode(text, PATH) == (other.encode(text, add_special_tokens=False).ids if text else [])


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab 1\n\t.'éß 　🚀"), max_size=80), st.integers(1, 20))
def test_pieces_join_and_encode_alike(text, size):
    parts = list(tokens.pieces(text, size))
    assert "".join(parts) == text
    enc = tokens.encoding(PATH)
    assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)
    assert tokens.decode(tokens.encode(text, PATH), PATH) == text.encode()


def test_very_long_text():
    text = "The quick brown fox. " * 20_000 + "z" * 3000
    assert tokens.decode(tokens.encode(text, PATH), PATH) == text.encode()
    assert tokens.encode(text, PATH) == tokens.encoding(PATH).encode_ordinary(text)


def test_table_round_trip_with_clashing_names(spark):
    rows = [(i, t, "more") for i, t in enumerate(TEXTS)] + [(None, "no key", "x"), (1, "again", "x")]
    df = spark.createDataFrame(rows, "ids long, key string, text string")
    got = tokens.encode_table(df, "ids", "key").toDF("k", "ids").collect()
    assert sorted((r["k"] is None, r["k"] or 0, r["ids"]) for r in got) == sorted((k is None, k or 0, tokens.encode(t, PATH)) for k, t, _ in rows)
    back = tokens.decode_table(spark.createDataFrame([(r["k"], r["ids"]) for r in got if r["k"] != 1], "k long, v array<int>"), "k", "v").toDF("k", "b").collect()
    assert {r["k"]: bytes(r["b"]).decode() for r in back} == {k: t or "" for k, t, _ in rows if k != 1}


def test_counts_and_empty_table(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None)], "k long, t string")
    assert {r["k"]: r["n_tokens"] for r in tokens.count_table(df, "k", "t").collect()} == {1: 2, 2: 0}
    assert tokens.encode_table(df.where("false"), "k", "t").count() == 0


@pytest.mark.parametrize("text", ["a" * 1_000_000, "ab" * 200_000, " " * 500_000, "\n " * 200_000, "株" * 200_000, "1" * 500_000])
def test_texts_without_safe_places_end_soon(text):
    import time

    began = time.perf_counter()
    ids = tokens.encode(text, PATH)
    assert time.perf_counter() - began < 20
    assert tokens.decode(ids, PATH) == text.encode()


def test_pieces_of_texts_without_spaces(monkeypatch):
    """Cut or whole: the same ids, with signs, marks, contractions, numbers and scripts side by side."""
    r = random.Random(4)
    signs = ["你好", "世界", "。", "，", "'s", "'ll", "’", "abc", "12", "½", "é", "é", "-", "_", "‍", "🚀", " ", "  ", "\n", "'", "''", "ß", "٣"]
    enc = tokens.encoding(f"{tokens.DEFAULT_FOLDER}/byte_bpe_50k.tiktoken")
    for _ in range(400):
        text = "".join(r.choice(signs) for _ in range(r.randint(1, 60)))
        parts = list(tokens.pieces(text, r.randint(1, 12)))
        assert "".join(parts) == text
        assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)
    assert max(map(len, tokens.pieces("你好世界。" * 50_000, 1000))) <= 1005
