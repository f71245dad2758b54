"""Best camera places and resection against plain numpy and known cameras."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallaxis.functions import camera as c
from parallaxis.functions import vector as v
from parallaxis.operators import framing, resection

from .test_scenes import cameras, pose, rig


def cloud(spark, rows):
    return spark.createDataFrame([tuple(map(float, p)) for p in rows], "x double, y double, z double").repartition(3)


def by_halving(view, at, margin):
    """The place by all points: its limits, then both sideways places by halving intervals."""
    m = np.array(view["w2c"]).reshape(4, 4)[:3, :3]
    right, up, ahead = m[0], m[1], -m[2]
    f = view["width"] / (2 * np.tan(np.radians(view["fovx_deg"]) / 2))
    s, size = at @ ahead, max(1.0, np.ptp(at, axis=0).max())
    sides = [(at @ right, view["cx"], view["width"]), (at @ up, view["cy"], view["height"])]
    slopes = [((margin - p) / f, (n - 1 - margin - p) / f) for _, p, n in sides]
    cf = min(s.min() - 1e-9 * size, *[((a - lo * s).min() - (a - hi * s).max()) / (hi - lo) for (a, _, _), (lo, hi) in zip(sides, slopes, strict=True)])
    out = []
    for (a, _, _), (lo, hi) in zip(sides, slopes, strict=True):
        left, end = (a - hi * (s - cf)).max(), (a - lo * (s - cf)).min()
        for _ in range(200 if end - left > 1e-6 * size else 0):
            half = (left + end) / 2
            seen = (a - half) / (s - cf)
            left, end = (half, end) if seen.min() + seen.max() > lo + hi else (left, half)
        out.append((left + end) / 2)
    return out[0] * right + out[1] * up + cf * ahead


@pytest.mark.parametrize("margin", [0, 7])
def test_best_places(spark, margin):
    rng = np.random.default_rng(2)
    at = rng.normal(size=(900, 3)) * (1, 0.5, 0.3) + (3, 1, 0)
    before = cameras(spark, [pose((0, 0, 9)), pose((5, 5, 5)), pose((-4, 1, 0.5)), *rig(5, seed=3)]).withColumn("cx", F.col("cx") + F.col("cam_idx"))
    points = cloud(spark, at).unionByName(spark.createDataFrame([(None, 0.0, 99.0), (float("nan"), 1e9, 0.0)], "x double, y double, z double"))
    after = framing.best_positions(before, points, margin=margin)
    views, found = {r["cam_idx"]: r for r in before.collect()}, {r["cam_idx"]: r for r in after.collect()}
    assert found.keys() == views.keys() and after.columns == before.columns
    for i, r in found.items():
        m, old = (np.array(x["w2c"]).reshape(4, 4) for x in (r, views[i]))
        assert np.allclose(m[:3, :3], old[:3, :3], atol=1e-9)
        assert np.allclose(-m[:3, :3].T @ m[:3, 3], by_halving(views[i].asDict(), at, margin), atol=1e-6)
    seen = c.project(cloud(spark, at).crossJoin(after), v.cols("x", "y", "z")).selectExpr("min(u * width - 0.5) as l", "max(u * width - 0.5 - width) as r", "min(v * height - 0.5) as b", "max(v * height - 0.5 - height) as t", "count(u) as n").first()
    assert seen["n"] == 900 * len(views) and min(seen["l"], seen["b"]) >= margin - 1e-4 and max(seen["r"], seen["t"]) <= -1 - margin + 1e-4


def test_few_points_and_no_room(spark):
    before = cameras(spark, [pose((0, 0, 9))])
    assert framing.best_positions(before, cloud(spark, [(1, 2, 3)]), 4).count() == 1
    assert framing.best_positions(before, cloud(spark, [(0, 0, 0), (1, 0, 0)]), 4).count() == 1
    assert framing.best_positions(before, cloud(spark, [(0, 0, 0), (1, 0, 0)]), 24).count() == 0, "a margin of half the height leaves no image"
    assert framing.best_positions(before, cloud(spark, [(0, 0, 0)]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        framing.best_positions(before, cloud(spark, [(0, 0, 0)]), -1)


def test_hull_corners_are_enough():
    rng = np.random.default_rng(1)
    for at in (rng.normal(size=(500, 2)), rng.integers(0, 4, (300, 2)).astype(float), np.repeat([[1.0, 2.0]], 90, 0), np.column_stack((np.arange(100.0), np.arange(100.0))), rng.normal(size=(200, 2)) * [1e6, 1e-6]):
        few = framing.hull_corners(at)
        way = rng.normal(size=(2, 400)) / np.maximum(np.abs(at).max(0), 1e-12)[:, None]
        assert np.allclose((at @ way).max(0), (few @ way).max(0), rtol=1e-12) and len(few) <= len(at)


def seen_pairs(spark, truth, points):
    return c.project(points.crossJoin(truth), v.cols("x", "y", "z")).select("cam_idx", "x", "y", "z", "u", "v")


def agree(truth, got, tolerance=1e-5):
    for r in truth.collect():
        assert got[r["cam_idx"]]["w2c"] == pytest.approx(r["w2c"], abs=tolerance) and got[r["cam_idx"]]["fovx_deg"] == pytest.approx(r["fovx_deg"], abs=tolerance)


@pytest.mark.parametrize("kind", ["space", "plane", "tilted plane"])
def test_cameras_from_points_and_pixels(spark, kind):
    """Null and not finite places and pairs are left out, also where points behind a camera have no place."""
    rng = np.random.default_rng(4)
    truth = cameras(spark, rig(4, seed=2)).withColumn("fovx_deg", 55.0 + F.col("cam_idx"))
    at = rng.normal(size=(40, 3)) * (1, 1, kind == "space")
    if kind == "tilted plane":
        at = at @ np.linalg.qr(rng.normal(size=(3, 3)))[0] + (0.3, -0.2, 0.1)
    pairs = seen_pairs(spark, truth, cloud(spark, at))
    holes = pairs.withColumns({"u": F.when(F.col("x") > 1.2, None).otherwise(F.col("u")), "v": F.when(F.col("y") > 1.3, float("nan")).otherwise(F.col("v"))})
    more = holes.unionByName(holes.limit(2).withColumns({"x": F.lit(float("inf")), "u": F.lit(0.5), "v": F.lit(0.5)}))
    start = truth.withColumn("fovx_deg", F.lit(60.0)).withColumn("w2c", F.lit(None).cast("array<double>"))
    got = {r["cam_idx"]: r for r in resection.resection(more, start, focal_weight=0.0).collect()}
    agree(truth, got)


def test_held_focal_length_and_open_cameras(spark):
    rng = np.random.default_rng(4)
    truth = cameras(spark, rig(4, seed=2)).withColumn("fovx_deg", 55.0 + F.col("cam_idx"))
    pairs = seen_pairs(spark, truth, cloud(spark, rng.normal(size=(30, 3))))
    start = truth.withColumn("fovx_deg", F.lit(60.0))
    near = {r["cam_idx"]: r["fovx_deg"] for r in resection.resection(pairs, start).collect()}
    assert all(min(60, 55 + i) - 0.01 <= near[i] <= max(60, 55 + i) + 0.01 for i in near)
    assert resection.resection(pairs.where("cam_idx > 0 or x > 99"), start, rounds=1).count() == 3
    line = seen_pairs(spark, truth, cloud(spark, [(0.1 * k, 0.2 * k, -0.1 * k) for k in range(9)]))
    assert resection.resection(line, start, rounds=1).count() == 0, "points in a line leave the camera open"


def test_plane_that_faces_the_camera_and_noise(spark):
    """A plane straight ahead says nothing about the focal length, which stays; noise moves little."""
    rng = np.random.default_rng(6)
    truth = cameras(spark, [pose((0, 0, 6))])
    pairs = seen_pairs(spark, truth, cloud(spark, rng.normal(size=(30, 3)) * (1, 1, 0)))
    got = {r["cam_idx"]: r for r in resection.resection(pairs, truth).collect()}
    agree(truth, got, 1e-4)
    rough = seen_pairs(spark, cameras(spark, rig(3, seed=8)), cloud(spark, rng.normal(size=(200, 3)))).withColumns({k: F.col(k) + F.randn(5) * 0.002 for k in "uv"})
    got = {r["cam_idx"]: r for r in resection.resection(rough, cameras(spark, rig(3, seed=8))).collect()}
    agree(cameras(spark, rig(3, seed=8)).select("cam_idx", "w2c", "fovx_deg"), {i: got[i].asDict() | {"fovx_deg": got[i]["fovx_deg"]} for i in got}, 0.7)
