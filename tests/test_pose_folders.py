"""Pose folders with rasters: written, read, and what is missing."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallaxis.sources import geometry, pose_folders

from .test_scenes import cameras, rig

H, W = 12, 16


def raster(spark, cams, values):
    """Rows of every camera's raster, values by function of (cam, row, col)."""
    rows = [(i, r, k, *map(float, values(i, r, k))) for i in cams for r in range(H) for k in range(W)]
    return spark.createDataFrame(rows, "cam_idx int, row int, col int, a double, b double, c double")


def table(df, names):
    return {(r["cam_idx"], r["row"], r["col"]): tuple(r[n] for n in names) for r in df.collect()}


def same(a, b, tolerance):
    assert a.keys() == b.keys() and len(a)
    assert np.allclose([a[k] for k in sorted(a)], [b[k] for k in sorted(a)], atol=tolerance)


@pytest.fixture(scope="module")
def parts(spark):
    cams = cameras(spark, rig(4, seed=3)).withColumn("image_id", F.concat(F.lit("view_"), F.col("cam_idx"), F.lit(".jpg"))).drop("scene")
    ids = range(4)
    return {
        "cameras": cams,
        "images": raster(spark, ids, lambda i, r, k: ((i + r) / 20, k / 20, 0.5)).toDF("cam_idx", "row", "col", *"rgb"),
        "masks": raster(spark, ids, lambda i, r, k: ((i + r + k) % 3 == 0, 0, 0)).selectExpr("cam_idx", "row", "col", "a > 0 as mask"),
        "depths": raster(spark, ids, lambda i, r, k: (1 + r + k / 7, i / 10, 0)).toDF("cam_idx", "row", "col", "depth", "conf", "none").drop("none"),
        "normals": raster(spark, ids, lambda i, r, k: np.array([r + 1, k - 3, i + 1]) / np.linalg.norm([r + 1, k - 3, i + 1])).toDF("cam_idx", "row", "col", "nx", "ny", "nz"),
    }


def test_round_trip(spark, parts, tmp_path):
    folder = str(tmp_path / "rig")
    points = spark.createDataFrame([(1.0, 2.5, -3.0), (0.1, 0.0, 1e-9)], "x double, y double, z double")
    pose_folders.write(folder, **parts, points=points)
    assert sorted(os.listdir(tmp_path)) == ["rig"], "nothing stays beside the folder"
    views, found = pose_folders.read(spark, folder)
    back = {r["cam_idx"]: r for r in views.collect()}
    for r in parts["cameras"].collect():
        assert np.allclose(back[r["cam_idx"]]["w2c"], r["w2c"], atol=1e-9) and back[r["cam_idx"]]["image_name"] == f"view_{r['cam_idx']}"
    same(table(parts["images"], "rgb"), table(found["images"], "rgb"), 0.5 / 255 + 1e-9)
    assert table(parts["masks"], ["mask"]) == table(found["masks"], ["mask"])
    same(table(parts["depths"], ["depth", "conf"]), table(found["depths"], ["depth", "conf"]), 1e-6)
    same(table(parts["normals"], pose_folders.NORMAL), table(found["normal_worlds"], pose_folders.NORMAL), 1e-6)
    assert set(found) == {"images", "masks", "depths", "normal_worlds", "normal_cameras"}
    assert geometry.points(spark, f"{folder}/sparse/0/points3D.ply").count() == 2
    pose_folders.write(folder, **{k: x for k, x in parts.items() if k != "depths"})
    assert len(os.listdir(f"{folder}/images")) == 4


def test_missing_rasters(spark, parts, tmp_path):
    """An image without a file drops its camera; other rasters may lack any; the other frame's normals follow from one."""
    folder = str(tmp_path / "rig")
    pose_folders.write(folder, **parts)
    os.remove(f"{folder}/images/view_1.png")
    os.remove(f"{folder}/masks/view_2.png")
    os.remove(f"{folder}/normal_worlds/view_0.npy")
    os.remove(f"{folder}/normal_cameras/view_3.npy")
    views, found = pose_folders.read(spark, folder)
    assert [r["image_name"] for r in views.orderBy("cam_idx").collect()] == ["view_0", "view_2", "view_3"]
    assert {r["cam_idx"] for r in found["masks"].select("cam_idx").distinct().collect()} == {0, 2}
    want = {(new, r, k): n for (i, r, k), n in table(parts["normals"], pose_folders.NORMAL).items() for new, old in enumerate((0, 2, 3)) if old == i}
    same(want, table(found["normal_worlds"], pose_folders.NORMAL), 1e-6)
    assert found["normal_cameras"].select("cam_idx").distinct().count() == 3
    views, found = pose_folders.read(spark, folder, ["depths"])
    assert set(found) == {"depths"} and views.count() == 4, "only what is asked for is read"
    with pytest.raises(ValueError):
        pose_folders.read(spark, folder, ["colours"])


def test_names_and_refusals(spark, parts, tmp_path):
    folder = str(tmp_path / "plain")
    pose_folders.write(folder, parts["cameras"].drop("image_id"), masks=parts["masks"])
    assert sorted(os.listdir(f"{folder}/masks")) == [f"{k:06d}.png" for k in (1, 2, 3, 4)] and not os.path.exists(f"{folder}/images")
    assert pose_folders.read(spark, folder)[0].count() == 0 and pose_folders.read(spark, folder, ["masks"])[0].count() == 4
    some = parts["cameras"].withColumn("image_id", F.when(F.col("cam_idx") > 0, F.col("image_id")))
    with pytest.raises(ValueError):
        pose_folders.write(str(tmp_path / "mixed"), some)
    with pytest.raises(ValueError, match="blanks"):
        pose_folders.write(str(tmp_path / "blank"), parts["cameras"].withColumn("image_id", F.concat("image_id", F.lit(" x"))))


def test_failed_write_leaves_nothing(spark, parts, tmp_path):
    bad = parts["masks"].withColumn("mask", F.when(F.col("cam_idx") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("mask")))
    with pytest.raises(Exception, match="lost"):
        pose_folders.write(str(tmp_path / "bad"), parts["cameras"], masks=bad)
    assert os.listdir(tmp_path) == []


def test_png_of_large_images():
    """All kinds of rows, whole diagonals at a time: large images take no turn a byte."""
    draw = np.random.default_rng(1)
    image = draw.integers(0, 256, (300, 400, 3), dtype=np.uint8)
    assert (np.round(geometry.parse_png(pose_folders.png_bytes(image)) * 255) == image).all()
    kinds, pixels = draw.integers(0, 5, 300), image.astype(int)
    pad = np.zeros((301, 401, 3), int)
    pad[1:, 1:] = pixels
    left, up, corner = pad[1:, :-1], pad[:-1, 1:], pad[:-1, :-1]
    p = left + up - corner
    order = np.stack([np.abs(p - left), np.abs(p - up), np.abs(p - corner)])
    paeth = np.choose(order.argmin(0), [left, up, corner])
    guess = np.choose(kinds[:, None, None], [0 * left, left, up, (left + up) // 2, paeth])
    assert (geometry._unfiltered(kinds, ((pixels - guess) & 255).astype(np.uint8)) == image).all()
