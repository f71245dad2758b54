"""Round trips through shards, and Elias-Fano against plain arrays."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from parallaxis.llm import tokenstore
from parallaxis.llm.eliasfano import EliasFano
from parallaxis.llm.queries import tokenizer_file

PATH = tokenizer_file("word_bpe_49k.json")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-(2**40), 2**40), max_size=600))
def test_elias_fano(values):
    values = np.sort(np.array(values, np.int64))
    data = b"head" + EliasFano.build(values).to_bytes() + b"tail"
    back, end = EliasFano.from_bytes(data, 4)
    assert data[end:] == b"tail" and back.values().tolist() == values.tolist()
    assert [back.select(i)[0] for i in range(len(values))] == values.tolist()
    assert all(back.select(i, n).tolist() == values[i : i + n].tolist() for i, n in ((0, len(values)), (len(values), 0), (len(values) // 3, len(values) // 2)))


def test_long_sequences_and_places_out_of_range():
    import pytest

    values = np.cumsum(np.random.default_rng(1).integers(0, 50, 200_003))
    coded = EliasFano.build(values)
    assert (coded.values() == values).all() and (coded.select(131_000, 69_003) == values[131_000:]).all()
    for wrong in ((-1, 1), (200_003, 1), (0, 200_004)):
        with pytest.raises(IndexError):
            coded.select(*wrong)


def test_space_is_near_the_bound():
    n = 100_000
    values = np.cumsum(np.random.default_rng(0).integers(0, 2000, n))
    assert EliasFano.build(values).nbytes * 8 < n * (2 + np.log2(values[-1] / n)) * 1.1


def test_documents_come_back_in_order(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    texts = {i * 7 % 101 - 20: f"Text {i} " * (i % 40) for i in range(101)} | {500: None, 501: "", 502: "long " * 30_000}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, start int").repartition(5)
    rows = sorted(tokenstore.read(tokenstore.write(df, PATH)).collect(), key=lambda r: r["doc_id"])
    at = 0
    assert [r["doc_id"] for r in rows] == sorted(texts)
    for r in rows:
        ids = np.array([*library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 1], "<u4")
        assert r["start"] == at and bytes(r["ids"]) == ids.tobytes()
        at += len(ids)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tokenstore.read(tokenstore.write(empty, PATH)).count() == 0
    rows = spark.createDataFrame([(None, "gone"), (3, "twice"), (3, "twice"), (3, "other")], "doc_id long, text string")
    out = tokenstore.read(tokenstore.write(rows, PATH)).collect()
    assert [r["doc_id"] for r in out] == [3, 3, 3] and sorted(r["start"] for r in out)[0] == 0
