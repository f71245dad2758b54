"""Every registered query of the numbered operators over whole tables: against its SQL, or every column against the libraries."""

import hashlib
import math
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from parallaxis.llm import queries
from parallaxis.llm.queries import tokenizer_file

from .test_pii import base

held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        db.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = db.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file(name))


def test_packing(spark, sf, texts):
    rows = [r.asDict() for r in queries.op4_packing(spark, sf).collect()]
    coder = library("byte_bpe_50k.json")
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    assert set(pieces) == set(texts)
    for i, t in texts.items():
        ids, at = np.array([*coder.encode(t, add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)
    for own in windows.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert sum(r["length"] for r in rows) > 0.95 * 1024 * len(windows)


def test_codec(spark, sf, texts):
    coder = library("word_bpe_49k.json")
    coder.no_truncation(), coder.no_padding()
    rows = {r["doc_id"]: r for r in queries.op6_bpe_codec(spark, sf).collect()}
    assert set(rows) == set(texts)
    for i, t in texts.items():
        ids = coder.encode(t, add_special_tokens=False).ids
        assert rows[i]["n_tokens"] == len(ids) and rows[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(coder.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_token_store(spark, sf, texts):
    coder, at, left = library("word_bpe_49k.json"), 0, dict(texts)
    for r in sorted(queries.op9_token_store(spark, sf).collect(), key=lambda r: r["doc_id"]):
        ids = np.array([*coder.encode(left.pop(r["doc_id"]), add_special_tokens=False).ids, 1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert not left


def test_personal_data(spark, sf, texts):
    rows = {r["doc_id"]: r for r in queries.op8_pii(spark, sf).collect()}
    assert set(rows) == set(texts)
    for i, t in texts.items():
        spans = base(t)
        kinds = [s.split(":")[0] for s in spans.split(",") if s]
        assert [rows[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [kinds.count(k) for k in ("email", "ip", "card", "phone")]
        assert rows[i]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert set(spans.split(",")) - {""} <= set(rows[i]["spans"].split(","))


@pytest.mark.parametrize("name", ["op1_toxicity", "op2_language_id"])
def test_scores(spark, sf, texts, name):
    rows = queries.QUERIES[name](spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and not math.isnan(r["score"]) for r in rows)
    if name == "op1_toxicity":
        assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)
    else:
        said = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
        checked = [r["lang_pred"] == said[r["doc_id"]] for r in rows if r["held_out"] and said[r["doc_id"]] and r["lang_pred"] != "und"]
        assert sum(checked) >= 0.95 * len(checked) > 0
