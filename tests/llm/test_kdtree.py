"""Top-k search against all inner products."""

import numpy as np
import pytest

from parallaxis.llm import kdtree

SCHEMA = "vec_id long, vector array<double>, score string"


def brute(vectors, queries, k):
    out = set()
    for q, v in queries.items():
        hits = sorted((-float(np.dot(v, w)), i) for i, w in vectors if i != q and len(w) == len(v))[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(hits)}
    return out


def answer(spark, rows, k, shard_rows):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    found = kdtree.top_k(df, df.where("vec_id % 5 = 0"), k, shard_rows)
    return {tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect()}


@pytest.mark.parametrize("shard_rows", [40_000, 500])
def test_all_hits_with_ties(spark, shard_rows):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(1500)] + [(2000 + i, [1.0] * 6) for i in range(700)]
    good = [(i, v) for i, v in rows]
    assert answer(spark, rows, 7, shard_rows) == brute(good, {i: v for i, v in good if i % 5 == 0}, 7)


def test_clustered_vectors_are_pruned_exactly(spark):
    rng = np.random.default_rng(2)
    heads = rng.normal(0, 20, (12, 8))
    rows = [(i, np.floor(heads[i % 12] + rng.normal(0, 1, 8)).tolist()) for i in range(2400)]
    assert answer(spark, rows, 5, 600) == brute(rows, {i: v for i, v in rows if i % 5 == 0}, 5)


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (5, None), (10, [1.0, None]), (15, [float("nan"), 1.0]), (20, [float("inf"), 1.0]), (None, [1.0, 1.0]), (1, [3.0, 1.0]), (2, [3.0, 1.0]), (25, [1.0, 1.0, 1.0])]
    assert answer(spark, rows, 20, 100) == {(0, 1, 1, 5.0), (0, 2, 2, 5.0)}
    assert answer(spark, [], 20, 100) == set()
    assert answer(spark, [(0, [1.0]), (0, [1.0]), (1, [2.0])], 3, 100) == {(0, 1, 1, 2.0)}


def test_empty_vectors_take_no_part(spark):
    df = spark.createDataFrame([(1, []), (2, [1.0, 2.0]), (3, [2.0, 1.0]), (4, None)], "vec_id long, vector array<double>")
    assert sorted(map(tuple, kdtree.top_k(df, df, 5).collect())) == [(2, 1, 3, 4.0), (3, 1, 2, 4.0)]


def test_cells_part_the_space_and_deal_out_equal_vectors():
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.normal(size=(2000, 5)), np.ones((1000, 5))))
    cells = kdtree.Cells(x, 12)
    at = cells.place(x, np.arange(len(x)))
    sizes = np.bincount(at, minlength=cells.shards)
    assert 12 <= cells.shards <= 20 and sizes.min() > 0 and sizes.max() < 600
    assert len(set(at[2000:])) >= 4, "equal vectors are in several shards"
    assert (kdtree.Cells(np.zeros((70, 3)), 5).place(np.zeros((10, 3)), np.arange(10)) == np.arange(10) % 5).all()


def test_many_shards_widths_and_equal_vectors(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(i, rng.integers(-9, 9, 6).astype(float).tolist()) for i in range(900)] + [(2000 + i, [1.0] * 6) for i in range(200)] + [(3000 + i, rng.integers(-9, 9, 2).astype(float).tolist()) for i in range(90)]
    want = brute(rows, {i: v for i, v in rows if i % 5 == 0}, 7)
    monkeypatch.setattr(kdtree, "CHUNK", 20)
    assert answer(spark, rows, 7, 64) == want
    monkeypatch.setattr(kdtree, "BOXES_SENT", 3)
    assert answer(spark, rows, 7, 64) == want
