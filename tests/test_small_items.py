"""Surface samples, points ahead, masks of other sizes and similarities of camera lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallaxis.functions import camera as c
from parallaxis.functions import vector as v
from parallaxis.operators import generate, images, meshes, normalize

from .test_scenes import cameras, rig


@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_surface_samples_are_as_many_as_asked(spark, n):
    rng = np.random.default_rng(1)
    at = np.concatenate([rng.normal(size=(20, 9)), np.tile(rng.normal(size=(1, 9)), (9, 1)), np.zeros((2, 9))])
    names = [f"{a}{m}" for m in range(3) for a in "xyz"]
    t = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(at)], "face_id long, " + ", ".join(f"{k} double" for k in names)).repartition(3)
    got = meshes.sample_surface(t, n, 5)
    counts = {r["face_id"]: r["count"] for r in got.groupBy("face_id").count().collect()}
    area = np.linalg.norm(np.cross(at[:, 3:6] - at[:, :3], at[:, 6:] - at[:, :3]), axis=1)
    want = area / area.sum() * n
    assert sum(counts.values()) == n and all(abs(counts.get(i, 0) - x) < 1 for i, x in enumerate(want))


def test_points_ahead_lie_in_view(spark):
    cams = cameras(spark, rig(3))
    got = generate.points_ahead(cams, 50, 2.0, 5.0, 3)
    seen = c.project(got.join(cams, "cam_idx"), v.cols("x", "y", "z")).selectExpr("count(*) as n", "min(u) as u0", "max(u) as u1", "min(v) as v0", "max(v) as v1", "min(depth) as d0", "max(depth) as d1").first()
    assert seen["n"] == 150 and 0 <= seen["u0"] < seen["u1"] <= 1 and 0 <= seen["v0"] < seen["v1"] <= 1 and 2 <= seen["d0"] < seen["d1"] <= 5
    assert generate.points_ahead(cams, 0, 1, 2, 3).count() == 0


def test_mask_of_another_size(spark):
    depth = spark.createDataFrame([(i, r, k, 1.0) for i in (0, 1) for r in range(4) for k in range(6)], "cam_idx int, row int, col int, depth double")
    masks = spark.createDataFrame([(0, r, k, k == 0) for r in range(2) for k in range(2) if (r, k) != (1, 0)], "cam_idx int, row int, col int, mask boolean")
    on = images.with_mask(depth, masks, (6, 4), (2, 2)).where("mask")
    assert {(r["row"], r["col"]) for r in on.where("cam_idx = 0").collect()} == {(r, k) for r in range(2) for k in range(3)}
    assert on.where("cam_idx = 1").count() == 24, "a camera without a mask sees all"


def test_similarity_of_camera_lists(spark):
    s = normalize.join_similarity(normalize.rotation_between(np.array([1.0, 0, 0]), np.array([0.0, 0.6, 0.8])), 1.7, np.array([1.0, -2, 0.5]))
    poses = rig(6, seed=3, spread=2.0)
    a = cameras(spark, poses).unionByName(cameras(spark, poses, 1)).unionByName(cameras(spark, poses[:5], 2)).unionByName(cameras(spark, poses, 3)).withColumn("image_id", F.concat(F.lit("i"), "cam_idx"))
    t = spark.createDataFrame([(i, s.ravel().tolist()) for i in range(4)], "scene int, transform array<double>")
    b = normalize.transform_cameras(cameras(spark, poses).unionByName(cameras(spark, poses, 1)).unionByName(cameras(spark, poses, 2)), t).drop("scale")
    b = b.withColumn("image_id", F.when((F.col("scene") == 1) & (F.col("cam_idx") == 2), "other").otherwise(F.concat(F.lit("i"), "cam_idx")))
    for check in (False, True):
        got = {r["scene"]: r for r in normalize.list_similarity(a, b, check_ids=check).collect()}
        assert set(got) == {0, 1, 2} and got[2]["transform"] is None
        assert np.allclose(got[0]["transform"], s.ravel(), atol=1e-9) and got[0]["scale"] == pytest.approx(1.7)
        assert (got[1]["transform"] is None) == check
