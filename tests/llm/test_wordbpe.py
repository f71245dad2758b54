"""The trie encoder against the tokenizers library."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from parallaxis.llm import wordbpe
from parallaxis.llm.queries import tokenizer_file

PATH = tokenizer_file("word_bpe_49k.json")
ENCODER = wordbpe.TrieEncoder(PATH)
TABLE = wordbpe.TokenTable(PATH)


def same(texts):
    want = [x.ids for x in ENCODER.library.encode_batch(texts, add_special_tokens=False)]
    got = list(ENCODER.encode_docs(texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert [TABLE.decode(x).decode() for x in got] == [ENCODER.library.decode(x, skip_special_tokens=False) for x in want]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=5))
def test_any_text(texts):
    same(texts)


def test_words_of_repeats_and_syllables():
    rng = random.Random(2)
    same(["a" * n for n in range(60)] + [" ".join("".join(rng.choice(["th", "e", "ing", "an", "aaa", "ß", "é", "东"]) for _ in range(rng.randrange(1, 12))) for _ in range(60)) for _ in range(50)])


def test_special_tokens_and_white_space():
    same(["<|startoftext|>a<|endoftext|> B", "<|endoftext|>", "a\x00\x1cb\x85c\xa0d", "İΣς İ", "I'LL don't 's", "½²x3", "  wide"])


def test_whole_tables(spark):
    texts = [None, "", "Hello hello HELLO", "x" * 100_000, "the " * 20_000, "x" * 100_000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = {r["doc_id"]: r for r in wordbpe.decode(wordbpe.encode(df, PATH), PATH).collect()}
    for i, t in enumerate(texts):
        ids = ENCODER.library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(rows[i]["ids"]), "<u4").tolist() == ids and rows[i]["decoded"] == ENCODER.library.decode(ids, skip_special_tokens=False)
    assert wordbpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(wordbpe, "CACHE_WORDS", 10)
    monkeypatch.setattr(wordbpe, "CACHE_PAIRS", 10)
    same([" ".join(f"word{i}{k}" for k in range(8)) for i in range(30)])


def test_other_vocabularies_are_refused():
    import pytest

    for kind in (wordbpe.TrieEncoder, wordbpe.TokenTable):
        with pytest.raises(ValueError):
            kind(tokenizer_file("byte_bpe_50k.json"))
