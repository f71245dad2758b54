"""Spatial operators on small scenes with known answers."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from parallaxis.functions import camera as c
from parallaxis.functions import vector as v
from parallaxis.operators import align, filters, images, matching, meshes, raster, voxels
from parallaxis.plans.visible import mark_visible


def front_cameras(spark, n=1, size=128):
    """Cameras three units before the origin on the z axis, looking at it."""
    rows = spark.range(n).select(F.col("id").cast("int").alias("cam_idx"), F.lit(size).alias("width"), F.lit(size).alias("height"), F.lit(60.0).alias("fovx_deg"), F.lit(None).cast("double").alias("fovy_deg"), F.lit(size / 2).alias("cx"), F.lit(size / 2).alias("cy"))
    return rows.withColumn("w2c", c.polar_pose(F.lit(0.0), F.col("cam_idx") * 0.5, F.lit(3.0), v.lit3(0, 0, 0)))


def voxel_points(spark, cells, r):
    return spark.createDataFrame([tuple((x + 0.5) / r - 0.5 for x in cell) for cell in cells], "x double, y double, z double")


def labels(spark, cells, r=16):
    return {tuple(row[:3]): row[3] for row in mark_visible(voxel_points(spark, cells, r), front_cameras(spark), r).collect()}


def test_the_nearer_of_two_voxels_is_seen(spark):
    got = labels(spark, [(8, 8, 12), (8, 8, 3)])
    assert got[8, 8, 12] == voxels.VALID and got[8, 8, 3] == voxels.UNKNOWN and len(got) == 16**3


def test_slab_has_free_space_before_it_and_none_behind(spark):
    got = labels(spark, [(i, j, 3) for i in (7, 8, 9) for j in (7, 8, 9)])
    assert all(got[8, 8, k] < 0 for k in range(5, 16))
    assert not [k for k in range(3) if got[8, 8, k] < 0]
    assert got[8, 8, 3] == voxels.VALID


def test_domain_counts_skip_what_is_not_finite(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 0.0), (0.5, -0.5, 0.5), (0.7, 0.0, 0.0), (float("nan"), 0.0, 0.0), (None, 0.0, 0.0), (float("inf"), 0.0, 0.0)], "x double, y double, z double")
    assert tuple(filters.domain_stats(rows).first()) == (3, 2)
    assert voxels.voxelize(rows, 4).count() == 2


def test_resolutions_and_levels_are_whole_and_positive():
    for bad in (0, -1, 2.5, True):
        with pytest.raises(ValueError):
            voxels.resolution(bad)
        with pytest.raises(ValueError):
            voxels.free_label(bad)
    assert voxels.free_label(3) == -3 and voxels.free_without_bound(8) == -24 and voxels.resolution(4.0) == 4


def test_distance_equals_brute_force(spark):
    rng = random.Random(0)
    r = 7
    on = {cell for cell in itertools.product(range(r), repeat=3) if rng.random() < 0.03}
    cells = spark.createDataFrame([(*cell, cell in on) for cell in itertools.product(range(r), repeat=3)], "i int, j int, k int, mask boolean")
    got = {tuple(x[:3]): x[3] for x in voxels.l1_distance(cells, r, "mask").select("i", "j", "k", "distance").collect()}
    assert got == {a: min(sum(abs(p - q) for p, q in zip(a, b, strict=True)) for b in on) for a in itertools.product(range(r), repeat=3)}
    assert {x[0] for x in voxels.l1_distance(cells.withColumn("mask", F.lit(False)), r, "mask").select("distance").collect()} == {3 * r}


def triangle(spark, *corners):
    return spark.createDataFrame([(0, *[x for p in corners for x in p])], "face_id long, " + ", ".join(f"{a}{m} double" for m in range(3) for a in "xyz"))


def test_triangles_without_area_count_by_their_corners(spark):
    flat = triangle(spark, (-0.4, -0.4, -0.4), (0.4, 0.4, 0.4), (0.0, 0.0, 0.0))
    assert {tuple(r[1:]) for r in voxels.voxelize_triangles(flat, 4).collect()} == {(0, 0, 0), (3, 3, 3), (2, 2, 2)}
    wide = triangle(spark, (-0.5, -0.5, 0.1), (0.5, -0.5, 0.1), (-0.5, 0.5, 0.1))
    got = {tuple(r[1:]) for r in voxels.voxelize_triangles(wide, 4).collect()}
    assert {k for _, _, k in got} == {2} and {(i, j) for i, j, _ in got} >= {(i, j) for i in range(4) for j in range(4) if i + j <= 3}


def test_the_nearer_triangle_wins_every_pixel(spark):
    far = triangle(spark, (-1.0, -1.0, -0.5), (1.0, -1.0, -0.5), (0.0, 1.0, -0.5))
    near = triangle(spark, (-1.0, -1.0, 0.5), (1.0, -1.0, 0.5), (0.0, 1.0, 0.5)).withColumn("face_id", F.lit(1).cast("long"))
    seen = raster.z_buffer(raster.fragments(far.unionByName(near), front_cameras(spark, size=32))).collect()
    inner = [r for r in seen if 8 <= r["row"] < 24 and r["face_id"] == 0]
    assert seen and not [r for r in inner if abs(r["col"] - 15.5) < 2]


def test_erosion_stops_at_the_border(spark):
    mask = spark.createDataFrame([(0, r, k, True) for r in range(5) for k in range(6)], "cam_idx int, row int, col int, mask boolean")
    kept = {(r["row"], r["col"]) for r in images.erode(mask, 1).where("mask").collect()}
    assert kept == {(r, k) for r in range(1, 4) for k in range(1, 5)}


def test_lower_quantile_is_an_order_statistic(spark):
    rows = spark.createDataFrame([(0, x) for x in (3.0, 1.0, 2.0)], "cam_idx int, conf double")
    assert filters.lower_quantile(rows, "cam_idx", "conf", 0.34, "q").first()["q"] == 1.0
    assert filters.lower_quantile(rows, "cam_idx", "conf", 1.0, "q").first()["q"] == 3.0


def test_assignment_has_the_least_cost(spark):
    rng = random.Random(3)
    n = 6
    cost = [[rng.randrange(50) for _ in range(n)] for _ in range(n)]
    df = spark.createDataFrame([(0, i, j, float(cost[i][j])) for i in range(n) for j in range(n)], "scene int, c_idx int, r_idx int, cost double")
    got = matching.assign(df).collect()
    assert sorted(r["c_idx"] for r in got) == sorted(r["r_idx"] for r in got) == list(range(n))
    assert sum(r["cost"] for r in got) == min(sum(cost[p[j]][j] for j in range(n)) for p in itertools.permutations(range(n)))


def test_farthest_views_spread(spark):
    cameras = front_cameras(spark, 3).withColumn("w2c", c.polar_pose(F.when(F.col("cam_idx") == 1, 0.1).when(F.col("cam_idx") == 2, 3.0).otherwise(0.0), F.lit(0.0), F.lit(3.0), v.lit3(0, 0, 0)))
    order = lambda k: [r["cam_idx"] for r in matching.farthest_cameras(cameras, k).orderBy("turn").collect()]
    assert order(2) == [0, 2] and order(0) == [0] and order(9) == [0, 1, 2]


def test_similarity_of_known_motion(spark):
    pts = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 2.0, 0.0), (0.0, 0.0, 3.0)]
    rows = spark.createDataFrame([(0, *p, 3 * p[1] + 1, -3 * p[0], 3 * p[2] - 2) for p in pts] + [(1, *pts[0], *pts[0])], "scene int, x double, y double, z double, tx double, ty double, tz double")
    got = {r["scene"]: r for r in align.similarity(rows).collect()}
    assert got[1]["scale"] is None and got[0]["scale"] == pytest.approx(3)
    assert got[0]["transform"] == pytest.approx([0, 3, 0, 1, -3, 0, 0, 0, 0, 0, 3, -2, 0, 0, 0, 1], abs=1e-9)


def test_sanitize_drops_bad_faces_and_renumbers(spark):
    vertices = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (5, 1.0, 0.0, 0.0), (7, 0.0, 1.0, 0.0), (9, float("nan"), 0.0, 0.0), (70000, 0.0, 0.0, 1.0)], "vid long, x double, y double, z double")
    faces = spark.createDataFrame([(0, 0, 5, 7), (1, 0, 0, 5), (2, 0, 5, 9), (3, 0, 5, 12345), (4, 0, 7, 70000)], "face_id long, v0 long, v1 long, v2 long")
    kept, left = meshes.sanitize(vertices, faces)
    assert {tuple(r) for r in left.collect()} == {(0, 0, 1, 2), (4, 0, 2, 3)}
    assert sorted(r["vid"] for r in kept.collect()) == [0, 1, 2, 3]


def test_projection_and_its_inverse(spark):
    rows = front_cameras(spark).select("*", F.lit(0.2).alias("x"), F.lit(-0.1).alias("y"), F.lit(0.3).alias("z"))
    seen = c.project(rows, v.cols("x", "y", "z"))
    back = seen.select(*c.back_project(F.col("u"), F.col("v"), F.col("depth"))).first()
    assert tuple(back) == pytest.approx((0.2, -0.1, 0.3))
    assert c.project(rows.withColumn("z", F.lit(4.0)), v.cols("x", "y", "z")).first()["u"] is None


def test_main_cluster_against_plain_numpy(spark):
    import numpy as np

    from parallaxis.operators import filters

    rng = np.random.default_rng(11)
    p = np.concatenate((rng.normal(0, 0.1, (3000, 3)), rng.uniform(-4, 4, (12, 3))))

    def core(at, share=0.01, depths=8, most=0.01):
        rows = np.arange(len(at))
        for depth in range(1, depths + 1):
            own = at[rows]
            lo, hi = own.min(0), own.max(0)
            if len(own) < 16 or (hi - lo).max() <= 0:
                break
            cell = np.clip(np.floor((own - lo) / np.where(hi > lo, hi - lo, 1) * 2**depth), 0, 2**depth - 1)
            _, which, n = np.unique(cell, axis=0, return_inverse=True, return_counts=True)
            good = n[which.ravel()] >= max(1, np.ceil(n.max() * share))
            if (~good).mean() > most:
                break
            rows = rows[good]
        return rows

    kept = p[core(p)]
    assert 0.5 * len(p) <= len(kept) < len(p)
    pad = (kept.max(0) - kept.min(0)) * 0.05
    want = set(np.flatnonzero(((p >= kept.min(0) - pad) & (p <= kept.max(0) + pad)).all(1)).tolist())
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "point_id long, x double, y double, z double")
    assert {r["point_id"] for r in filters.main_cluster(df).collect()} == want and len(want) < len(p)
