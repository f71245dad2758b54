"""Visibility labels of a voxel grid: occupied voxels, their rendered boundary, proofs of emptiness, distances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evidence, images, raster, voxels
from ..storage import kept


def candidates(cameras: DataFrame, r: int, points: DataFrame | None = None, triangles: DataFrame | None = None, depth: DataFrame | None = None, size: tuple[int, int] = (0, 0)) -> DataFrame:
    """Occupied voxels: those of points, those that triangles meet, or, with neither, those of the points that depth rasters of
    this width and height show inside their masks."""
    found = []
    if points is not None:
        found.append(voxels.voxelize(points, r))
    if triangles is not None:
        found.append(voxels.voxelize_triangles(triangles, r).select(*voxels.IJK))
    if not found:
        if depth is None:
            raise ValueError("points, triangles or depth rasters are needed")
        found.append(voxels.voxelize(images.depth_points(depth, cameras, *size), r))
    return reduce(DataFrame.unionByName, found).distinct()


def mark_visible(points: DataFrame | None, cameras: DataFrame, r: int, triangles: DataFrame | None = None, depth: DataFrame | None = None, masks: DataFrame | None = None, unknown: DataFrame | None = None, size: tuple[int, int] = (0, 0)) -> DataFrame:
    """(i, j, k, label) of the whole grid: 1 for voxels that some camera sees, -K for voxels that some camera proves empty
    at L1 distance K from what is not empty, else 0. One rendering serves both proofs.

    masks: (cam_idx, row, col, mask) rasters of this size: outside its mask a camera sees nothing, so it shows no voxel there and
    its rays are empty. unknown: points whose voxels stay unknown though proved empty. Without any candidate all is unknown."""
    spark = cameras.sparkSession
    occupied = kept(candidates(cameras, r, points, triangles, depth, size), "occupied")
    if occupied.isEmpty():
        return voxels.grid(spark, r).withColumn("label", F.lit(voxels.UNKNOWN).cast("long"))
    faces = voxels.boundary_triangles(occupied, r)
    seen = kept(raster.z_buffer(raster.fragments(faces, cameras)), "seen")
    shown = seen if masks is None else inside_masks(seen, cameras, masks, size)
    owner = F.floor(F.col("face_id") / 12)
    at = {"i": F.floor(owner / (r * r)), "j": F.floor(owner / r) % r, "k": owner % r}
    visible = shown.select(*[e.cast("int").alias(n) for n, e in at.items()]).distinct()
    free = evidence.free_evidence(cameras, seen, r, occupied, masks, size)
    if unknown is not None:
        free = free.join(voxels.voxelize(unknown, r), list(voxels.IJK), "left_anti")
    return voxels.labels(spark, r, visible, free)


def inside_masks(seen: DataFrame, cameras: DataFrame, masks: DataFrame, size: tuple[int, int]) -> DataFrame:
    """Seen pixels that lie in their camera's mask, looked up at the nearest of its pixels; cameras without a mask show all."""
    from ..functions import camera as c
    from ..operators import small

    width, height = size
    rows = seen.join(small(cameras.select("cam_idx", "width", "height")), "cam_idx")
    u, w = (F.col("col") + 0.5) / F.col("width"), (F.col("row") + 0.5) / F.col("height")
    rows = rows.withColumns({"mr": c.nearest_pixel(w, F.lit(height)), "mc": c.nearest_pixel(u, F.lit(width))})
    on = masks.where("mask").select("cam_idx", F.col("row").alias("mr"), F.col("col").alias("mc"))
    has = masks.select("cam_idx").distinct()
    return rows.join(on, ["cam_idx", "mr", "mc"], "left_semi").select(seen.columns).unionByName(seen.join(has, "cam_idx", "left_anti").select(seen.columns))
