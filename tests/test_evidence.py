"""Proofs of emptiness in blocks: the same voxels as all nine-point proofs give, from far fewer rows."""

import pytest
from pyspark.sql import functions as F

from parallaxis.operators import evidence, raster, voxels
from parallaxis.sources import fixtures as fx
from parallaxis.storage import kept


def scene(spark, sf, r, radius=2.5):
    cameras = kept(fx.cameras(spark, sf, radius), "cameras")
    occupied = kept(voxels.voxelize(fx.points(spark, sf, 2.0), r), "occupied")
    seen = kept(raster.z_buffer(raster.fragments(voxels.boundary_triangles(occupied, r), cameras)), "seen")
    return cameras, occupied, seen


def rows_of(df):
    return sorted(map(tuple, df.select(*voxels.IJK).collect()))


@pytest.mark.parametrize("r, radius, masked", [(11, 2.5, False), (16, 0.8, False), (12, 1.2, True)])
def test_same_voxels_as_every_proof(spark, sf, r, radius, masked):
    """Also where cameras stand in the cube, blocks are cut at its side, and masks of another size hide some of the image."""
    cameras, occupied, seen = scene(spark, sf, r, radius)
    cameras = kept(cameras.where("cam_idx < 9"), "some")
    masks, size = None, (0, 0)
    if masked:
        size = (31, 17)
        grid = cameras.where("cam_idx <> 4").select("cam_idx", F.explode(F.sequence(F.lit(0), F.lit(16))).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("col"))
        masks = kept(grid.withColumn("mask", (F.col("col") > 12) | (F.col("row") % 5 == 0)).where("row <> 3 or col <> 3"), "masks")
    empty = voxels.grid(spark, r).join(occupied, list(voxels.IJK), "left_anti")
    every = evidence.passing(empty.join(F.broadcast(cameras.select("cam_idx"))), cameras, seen, r, masks, size).select(*voxels.IJK).distinct()
    found = evidence.free_evidence(cameras, seen, r, occupied, masks, size)
    assert rows_of(found) == rows_of(every) and rows_of(found)


def test_rows_follow_the_surfaces(spark, sf):
    """Few rows both where single voxels hover before nothing, and where a wall makes all before it empty."""
    r = 64
    cameras, occupied, seen = scene(spark, sf, r)
    speckle, walls = [], []
    evidence.free_evidence(cameras, seen, r, occupied, made=speckle)
    assert sum(speckle) < r**3 * cameras.count() * 9 / 10, speckle
    shell = kept(voxels.grid(spark, r).where("greatest(i, j, k) = 63 or least(i, j, k) = 0"), "shell")
    inside = kept(fx.cameras(spark, sf, 0.3), "inside")
    seen = kept(raster.z_buffer(raster.fragments(voxels.boundary_triangles(shell, r), inside)), "seen")
    assert evidence.free_evidence(inside, seen, r, shell, made=walls).count() > r**3 / 2
    assert sum(walls) < r**3 * inside.count() * 9 / 30, walls


def test_nothing_seen_proves_nothing(spark, sf):
    cameras, occupied, seen = scene(spark, sf, 6)
    assert evidence.free_evidence(cameras, seen.limit(0), 6).count() == 0
    assert evidence.free_evidence(cameras.limit(0), seen, 6).count() == 0
    off = cameras.select("cam_idx", F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(False).alias("mask"))
    blind = evidence.free_evidence(cameras, seen.limit(0), 6, masks=off, size=(1, 1))
    assert blind.count() > 0, "rays outside a mask are empty"


def test_pyramid_of_odd_frames(spark):
    """Squares at the frame's edge are whole though cut; a missing pixel makes those that hold it not whole."""
    pixels = spark.createDataFrame([(0, r, c, float(10 * r + c)) for r in range(3) for c in range(5) if (r, c) != (2, 4)], "cam_idx int, row int, col int, end double")
    table = evidence.pyramid(pixels, spark.createDataFrame([(0, 5, 3)], "cam_idx int, width int, height int"))
    found = {(x["level"], x["a"], x["b"]): (x["low"], x["high"], x["whole"]) for x in table.collect()}
    assert found[0, 0, 0] == (0, 22, True) and found[0, 1, 3] == (13, 23, False) and found[0, 2, 0] == (20, 22, True)
    assert found[1, 0, 0] == (0, 23, False) and found[1, 1, 0] == (20, 23, False) and found[0, 0, 4] == (4, 14, False)
