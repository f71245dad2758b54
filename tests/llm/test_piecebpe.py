import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from parallaxis.llm import piecebpe, queries
from parallaxis.llm.queries import tokenizer_file

PATH = tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    return piecebpe.PieceCodec(PATH)


def agree(library, codec, texts):
    for text, ids in zip(texts, codec.encode_docs(texts), strict=True):
        want = library.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(text[:100])
        assert codec.decode(ids) == library.decode(want)


def test_edges(library, codec):
    agree(library, codec, ["", " ", "  hello  wörld \n\t x", "▁▁a▁", " " * 40 + "a", "한국 한\x00z 𝔘😀漢字", "<s></s><unk><0x0A>", "\n" * 50, "é é", "﻿a"])


def test_any_mixture(library, codec):
    draw = random.Random(5)
    parts = ["a", "b", "th", " ", "  ", "▁", "\n", "é", "ing", "0", "漢", "😀", "한", "ال", "до", "==", "\x00", "İ"]
    agree(library, codec, ["".join(draw.choices(parts, k=draw.randrange(150))) for _ in range(1500)])
    pieces = [library.id_to_piece(i) for i in range(259, 32000)]
    agree(library, codec, ["".join(draw.choices(pieces, k=draw.randrange(60))) for _ in range(1500)])


def test_very_long_texts(library, codec):
    draw = random.Random(6)
    agree(library, codec, [" " * 300_001, "a" * 300_000, "".join(draw.choices("abcdefghij", k=300_000)), "".join(chr(draw.randrange(0x4E00, 0x9FFF)) for _ in range(100_000)), "ab " * 200_000])


def test_blanks_of_every_number(library, codec):
    agree(library, codec, [" " * n + tail for n in range(70) for tail in ("", "x", "the", "\n")])


def test_cache_starts_anew(library, codec, monkeypatch):
    monkeypatch.setattr(piecebpe, "CACHE_WORDS", 5)
    monkeypatch.setattr(piecebpe, "CHARS", 20)
    agree(library, codec, ["one two three four", "five six seven eight", "one two nine ten", "x" * 200, "x" * 200])


def test_bytes_that_are_no_text(library, codec):
    for ids in ([3 + 0xE4, 3 + 0xBD, 300], [3 + 0xFF, 3 + 0x80], [0, 300], [3 + 0xE4, 3 + 0xBD, 3 + 0xA0], [1, 3 + 0x20, 300], [1, 260, 300, 2], [2]):
        assert codec.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids)


def test_other_models_are_refused(tmp_path):
    with pytest.raises(Exception):
        piecebpe.PieceCodec(tokenizer_file("word_bpe_49k.json"))


def test_tables(spark):
    rows = [(1, None, "x"), (1, "a b", "y"), (None, "", None), (2, "a b", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumnRenamed("ids", "decoded")
    out = piecebpe.decode(piecebpe.encode(docs, PATH), PATH)
    assert sorted((r["doc_id"] or 0, r["decoded"], len(r["ids"]) // 4) for r in out.collect()) == [(0, "", 2), (1, "", 2), (1, "a b", 4), (2, "a b", 4)]
    assert piecebpe.decode(piecebpe.encode(docs.where("false"), PATH), PATH).count() == 0


def test_query(spark, sf, library):
    rows = {r["doc_id"]: r for r in queries.op12_piece_codec(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert set(rows) == {d["doc_id"] for d in docs}
    for d in docs:
        ids, r = library.encode(d["text"] or "", add_bos=True, add_eos=True), rows[d["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
