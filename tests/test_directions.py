"""Widest angles against all pairs."""

import numpy as np
import pytest

from parallaxis.operators import directions


def unit(rows):
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def test_all_pairs_of_several_scenes(spark, monkeypatch):
    monkeypatch.setattr(directions, "PAIRS_EACH", 1)
    monkeypatch.setattr(directions, "PAIRS_LEAST", 50)
    draw = np.random.default_rng(3)
    scenes = {0: unit(draw.normal(size=(300, 3))), 1: unit(draw.normal(size=(200, 3)) * 0.01 + [1, 0, 0]), 2: unit(draw.normal(size=(1, 3))), 3: np.repeat([[0.0, 0.0, 1.0]], 50, 0), 4: np.array([[0.0, 0, 1], [0, 0, -1], [0, 1, 0]])}
    rows = spark.createDataFrame([(s, *map(float, p)) for s, at in scenes.items() for p in at] + [(5, None, 0.0, 1.0), (4, float("nan"), 0.0, 0.0)], "scene int, x double, y double, z double")
    found = {r["scene"]: r["angle_deg"] for r in directions.widest_angles(rows).collect()}
    want = {s: np.degrees(np.arccos(np.clip((at @ at.T).min(), -1, 1))) for s, at in scenes.items()} | {5: 0.0}
    assert found.keys() == want.keys() and all(abs(found[s] - x) < 1e-5 for s, x in want.items())


@pytest.mark.parametrize("half", [False, True])
def test_pairs_met_stay_few(spark, half):
    """Over the whole sphere, where every direction has one nearly opposite, and over a half of it."""
    draw = np.random.default_rng(5)
    at = unit(draw.normal(size=(8000, 3)))
    if half:
        at[:, 2] = np.abs(at[:, 2])
    made = []
    rows = spark.createDataFrame([(0, *map(float, p)) for p in at], "scene int, x double, y double, z double")
    angle = directions.widest_angles(rows, made=made).first()["angle_deg"]
    assert abs(angle - np.degrees(np.arccos(np.clip((at @ at.T).min(), -1, 1)))) < 1e-4
    assert sum(made) < len(at) ** 2 / 30, made
