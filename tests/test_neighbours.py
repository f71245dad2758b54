"""Neighbours and normals against all pairs."""

import numpy as np
import pytest

from parallaxis.operators import neighbours

COLUMNS = "id long, x double, y double, z double"


def table(spark, at, first=0):
    return spark.createDataFrame([(first + i, *map(float, p)) for i, p in enumerate(at)], COLUMNS).repartition(3)


def brute(queries, points, k):
    far = ((queries[:, None] - points[None]) ** 2).sum(2)
    return {(i, r + 1): int(j) for i, row in enumerate(far) for r, j in enumerate(np.lexsort((np.arange(len(points)), row))[:k])}


def cloud(kind):
    draw = np.random.default_rng(7)
    if kind == "even":
        return draw.random((400, 3))
    if kind == "dense":  # most points in a speck, some at one place, a few far away
        return np.concatenate([draw.normal(0, 1e-6, (200, 3)), np.repeat([[0.25, 0.5, 0.5]], 60, 0), draw.random((60, 3)) * 100])
    if kind == "lattice":
        return np.stack(np.meshgrid(*[np.arange(7.0)] * 3), -1).reshape(-1, 3)
    return np.array([[1.0, 2.0, 3.0]] * 5)


@pytest.mark.parametrize("kind", ["even", "dense", "lattice", "one place"])
@pytest.mark.parametrize("k", [1, 6])
def test_all_pairs(spark, kind, k):
    at = cloud(kind)
    found = neighbours.nearest(table(spark, at), table(spark, at), k, keep_most=8).collect()
    assert {(r["id"], r["rank"]): r["near_id"] for r in found} == brute(at, at, k) and len(found) == len(at) * min(k, len(at))


def test_queries_outside_and_few_points(spark):
    draw = np.random.default_rng(8)
    points, queries = draw.random((50, 3)), draw.normal(0, 5, (40, 3))
    found = neighbours.nearest(table(spark, queries), table(spark, points), 60).collect()
    assert {(r["id"], r["rank"]): r["near_id"] for r in found} == brute(queries, points, 60)


def test_rows_without_a_place(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, None, 0.0, 0.0), (3, float("nan"), 0.0, 0.0), (4, 1.0, 0.0, float("inf")), (5, 3.0, 0.0, 0.0)], COLUMNS)
    assert sorted((r["id"], r["near_id"]) for r in neighbours.nearest(rows, rows, 9).collect()) == [(1, 1), (1, 5), (5, 1), (5, 5)]
    assert neighbours.nearest(rows, rows.limit(0), 2).count() == 0 == neighbours.nearest(rows.limit(0), rows, 2).count()


def test_normals_of_a_plane_and_of_a_sphere(spark):
    draw = np.random.default_rng(9)
    flat = draw.random((300, 3)) @ np.array([[1, 0, 1], [0, 1, 1], [0, 0, 0]]) + [1e6, 0, 0]
    normal = np.array([1, 1, -1]) / np.sqrt(3)
    for r in neighbours.estimated_normals(table(spark, flat), 10).collect():
        n = np.array([r["nx"], r["ny"], r["nz"]])
        assert abs(abs(n @ normal) - 1) < 1e-5 and n[np.abs(n).argmax()] > 0
    ball = draw.normal(size=(2000, 3))
    ball /= np.linalg.norm(ball, axis=1, keepdims=True)
    rows = neighbours.estimated_normals(table(spark, ball), 12).collect()
    assert np.mean([abs(ball[r["id"]] @ [r["nx"], r["ny"], r["nz"]]) for r in rows]) > 0.99
    lone = neighbours.estimated_normals(table(spark, [[0, 0, 0], [1, 1, 1]])).collect()
    assert [(r["nx"], r["ny"], r["nz"]) for r in lone] == [(0, 0, 1)] * 2
