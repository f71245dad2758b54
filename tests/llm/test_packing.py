"""Packing against the tokenizers library, piece by piece."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from parallaxis.llm import packing
from parallaxis.llm.queries import tokenizer_file

JSON, RANKS = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken")
TEXTS = [None, "", "a", "Hello, world!", "naïve café ☕ 東京", "<|endoftext|> inside", " " * 3000, "word " * 4000, "x" * 5000, "don't  stop\n\n\nnow"] + [f"text number {i} " * (i % 90) for i in range(300)]


def check(spark, ranks):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    df = spark.createDataFrame([(i, t, "clash", 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string, offset int").repartition(3)
    rows = packing.pack(df, JSON, ranks, open_windows=8).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    for i, t in enumerate(TEXTS):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and bytes(r["ids"]) == ids[at : at + r["length"]].tobytes()
            assert zlib.crc32(bytes(r["ids"])) == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in windows.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 1024 or at & (at - 1) == 0, "sequences are full, or need no padding"


def test_pieces_cover_all_ids_without_padding(spark):
    check(spark, RANKS)


def test_the_library_alone_gives_the_same(spark):
    check(spark, None)


def test_best_fit_and_fullest_first():
    p = packing.Packer(10, 2, 0)
    one = lambda n: np.arange(n, dtype=np.uint32)
    assert p.add(1, one(6)) == [] and p.add(2, one(7)) == []
    p.add(3, one(3))  # best fit is the second window, which this fills
    assert [f for f, _ in p.open] == [4]
    p.add(4, one(8))
    done = p.add(5, one(5))  # no room: the fullest is filled with a first part of it
    assert len(done) == 1 and sum(len(x[2]) for x in done[0][1]) == 10


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), JSON, RANKS).count() == 0


@pytest.mark.parametrize("size", [64, 1024])
def test_null_id_and_repeated_rows(spark, size):
    df = spark.createDataFrame([(None, "one two"), (7, "three " * 100), (7, "three " * 100)], "doc_id long, text string")
    rows = packing.pack(df, JSON, RANKS, size=size).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 7) == 2 * next(r["doc_tokens"] for r in rows if r["doc_id"] == 7)
    assert sum(r["length"] for r in rows if r["doc_id"] is None) == 3
