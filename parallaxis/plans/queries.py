"""Registered queries of the spatial operators over the derived fixtures."""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import camera as c
from ..functions import vector as v
from ..operators import align, filters, generate, images, matching, meshes, normalize, raster, small, voxels
from ..sources import colmap
from ..sources import fixtures as fx
from .visible import mark_visible

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(x: Column | str, name: str) -> Column:
    return (F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)).alias(name)


def xyz(t: v.Vec, prefix: str = "") -> list[Column]:
    return [r6(x, prefix + n) for x, n in zip(t, "xyz", strict=True)]


@query
def mark_visible_labels(spark, sf_dir):
    labels = mark_visible(fx.points(spark, sf_dir, 2.0), fx.cameras(spark, sf_dir), 8)
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query
def camera_intrinsics(spark, sf_dir):
    return fx.cameras(spark, sf_dir).select("cam_idx", r6(c.fx(), "fx"), r6(c.fy(), "fy"), r6(c.fovy_deg(), "fovy"), r6(c.fovx_of(c.fx(), F.col("width")), "fovx"))


@query
def camera_pose_parts(spark, sf_dir):
    return fx.cameras(spark, sf_dir).select("cam_idx", *xyz(c.position(), "p"), *xyz(c.forward(), "f"), *xyz(c.up(), "u"))


@query
def camera_to_world(spark, sf_dir):
    m = fx.cameras(spark, sf_dir).select("cam_idx", c.inverse_pose().alias("m"))
    return m.select("cam_idx", *[r6(F.col("m")[4 * i + j], f"m{i}{j}") for i in range(3) for j in range(4)])


@query
def camera_flipped_frames(spark, sf_dir):
    m = fx.cameras(spark, sf_dir).select("cam_idx", c.flip("w2c", c.BOTH_FRAMES).alias("a"), c.flip("w2c", c.CAMERA_FRAME).alias("b"))
    return m.select("cam_idx", *[r6(F.col(n)[4 * i + j], f"{n}{i}{j}") for n in "ab" for i in range(3) for j in range(4)])


@query
def camera_polar_angles_all(spark, sf_dir):
    phi, theta = c.polar()
    return fx.cameras(spark, sf_dir).select("cam_idx", r6(phi, "phi"), r6(theta, "theta"))


@query
def camera_polar_angles(spark, sf_dir):
    return camera_polar_angles_all(spark, sf_dir)


@query
def camera_quaternions(spark, sf_dir):
    return camera_quaternions_all(spark, sf_dir)


@query
def camera_quaternions_all(spark, sf_dir):
    rows = colmap.poses(fx.cameras(spark, sf_dir, phase=0.3))
    # opposite signs name the same rotation; products do not depend on it
    w, x, y, z = v.cols("qw", "qx", "qy", "qz")
    return rows.select("cam_idx", r6(x * x, "xx"), r6(y * y, "yy"), r6(z * z, "zz"), r6(w * x, "wx"), r6(w * y, "wy"), r6(w * z, "wz"), *[r6(t, t) for t in ("tx", "ty", "tz")])


@query
def camera_clip_matrix(spark, sf_dir):
    m = fx.cameras(spark, sf_dir).select("cam_idx", c.clip_matrix().alias("m"))
    return m.select("cam_idx", *[r6(F.col("m")[4 * i + j], f"m{i}{j}") for i in range(4) for j in range(4)])


@query
def look_at_poses(spark, sf_dir):
    posed = c.look_at(fx.points(spark, sf_dir), v.scale(v.cols("x", "y", "z"), 10.0), v.lit3(0, 0, 0), v.lit3(0, 0, 1))
    return posed.select("point_id", *[r6(x, f"r{i}{j}") for i, row in enumerate(c.rotation()) for j, x in enumerate(row)], *xyz(c.translation(), "t"))


def projected(spark, sf_dir):
    return c.project(fx.points(spark, sf_dir).join(small(fx.cameras(spark, sf_dir))), v.cols("x", "y", "z"))


@query
def project_points(spark, sf_dir):
    return projected(spark, sf_dir).select("cam_idx", "point_id", r6("u", "u"), r6("v", "v"), r6("depth", "depth"))


@query
def points_in_frame(spark, sf_dir):
    near = c.project(fx.points(spark, sf_dir, 6.0).join(small(fx.cameras(spark, sf_dir))), v.cols("x", "y", "z"))
    framed = F.coalesce(F.col("u").between(0, 1) & F.col("v").between(0, 1), F.lit(False))
    return near.groupBy("cam_idx").agg(F.count_if(framed).alias("framed"), F.count_if(F.col("u").isNull()).alias("behind"))


@query
def camera_depth_range(spark, sf_dir):
    front = projected(spark, sf_dir).where("depth > 0").groupBy("cam_idx").agg(F.min("depth").alias("lo"), F.max("depth").alias("hi"))
    near = F.greatest(0.5 * F.col("lo"), F.lit(1e-4))
    return front.select("cam_idx", r6(near, "near"), r6(F.greatest(2 * F.col("hi"), 10 * near), "far"))


@query
def depth_to_world(spark, sf_dir):
    return depth_to_world_all(spark, sf_dir)


@query
def depth_to_world_all(spark, sf_dir):
    at = images.world_points(fx.depth_pixels(spark, sf_dir), fx.cameras(spark, sf_dir), 40, 25)
    return at.select("cam_idx", "row", "col", *xyz(v.cols("x", "y", "z")))


@query
def depth_confidence_quantile(spark, sf_dir):
    return filters.lower_quantile(fx.depth_pixels(spark, sf_dir), "cam_idx", "conf", 0.34, "least")


@query
def depth_mask_pixels(spark, sf_dir):
    return images.depth_mask(fx.depth_pixels(spark, sf_dir), 0.8).select("cam_idx", "row", "col", "depth", "conf")


@query
def depth_visualised(spark, sf_dir):
    shown = images.normalized(fx.depth_pixels(spark, sf_dir), "depth", "shade")
    return shown.groupBy("cam_idx").agg(r6(F.avg("shade"), "mean"), r6(F.max("shade"), "top"), F.sum(images.to_byte(F.round("shade", 9))).alias("bytes"))


@query
def mask_eroded(spark, sf_dir):
    return images.erode(fx.depth_pixels(spark, sf_dir).select("cam_idx", "row", "col", "mask"), 1).where("mask").select("cam_idx", "row", "col")


@query
def mask_crop_box(spark, sf_dir):
    pixels = fx.depth_pixels(spark, sf_dir).withColumn("mask", F.col("mask") & F.col("row").between(5, 15) & F.col("col").between(8, 30))
    return images.crop_box(pixels, 40, 25, 2)


@query
def masked_crop(spark, sf_dir):
    pixels = fx.depth_pixels(spark, sf_dir).withColumn("mask", F.col("conf") > 450)
    return images.crop(pixels.select("cam_idx", "row", "col", "conf"), images.crop_box(pixels, 40, 25, 1))


@query
def nearest_samples(spark, sf_dir):
    at = projected(spark, sf_dir).where("u between 0 and 1 and v between 0 and 1")
    u, w = F.round("u", 9), F.round("v", 9)
    return at.select("cam_idx", "point_id", c.nearest_pixel(u, F.lit(40)).alias("a"), c.nearest_pixel(1 - w, F.lit(25)).alias("b"), c.covering_pixel(u, F.lit(40)).alias("p"), c.covering_pixel(1 - w, F.lit(25)).alias("q"))


@query
def letterbox_places(spark, sf_dir):
    n = F.col("n_nationkey")
    return fx.read(spark, sf_dir, "nation").select("n_nationkey", *[e.alias(k) for k, e in images.letterbox(100 + 7 * n, 60 + 11 * n, 128, 96).items()])


@query
def nearest_cameras(spark, sf_dir):
    return matching.nearest_cameras(fx.cameras(spark, sf_dir, 2.7, 0.21), fx.cameras(spark, sf_dir))


@query
def polar_nearest_cameras(spark, sf_dir):
    return matching.nearest_cameras(fx.cameras(spark, sf_dir, 2.7, 0.21), fx.cameras(spark, sf_dir), polar=True)


@query
def farthest_cameras(spark, sf_dir):
    return matching.farthest_cameras(fx.cameras(spark, sf_dir), 6)


@query
def camera_match_cost(spark, sf_dir):
    return matching.match_cost(fx.cameras(spark, sf_dir, 2.7, 0.21), fx.cameras(spark, sf_dir), 2.5).select("c_idx", "r_idx", r6("cost", "cost"), F.round("angle_deg", 4).alias("angle"))


@query
def camera_assignment(spark, sf_dir):
    costs = matching.match_cost(fx.cameras(spark, sf_dir, 2.7, 0.21), fx.cameras(spark, sf_dir), 2.5).withColumn("scene", F.lit(0))
    return matching.assign(costs).select("c_idx", "r_idx", r6("cost", "cost"))


@query
def view_spread(spark, sf_dir):
    return view_spread_all(spark, sf_dir)


@query
def view_spread_all(spark, sf_dir):
    return matching.max_view_angle(fx.cameras(spark, sf_dir)).select(F.round("angle_deg", 4).alias("angle"))


@query
def trajectory_radius(spark, sf_dir):
    return matching.trajectory_radius(fx.cameras(spark, sf_dir)).select(r6("radius", "radius"))


@query
def voxel_counts(spark, sf_dir):
    return voxels.counts(fx.dense_points(spark, sf_dir), 16)


@query
def voxelized_points(spark, sf_dir):
    return voxels.voxelize(fx.points(spark, sf_dir, 4.0), 8).select("i", "j", "k", voxels.flat_index(8).alias("flat"))


@query
def domain_statistics(spark, sf_dir):
    return filters.domain_stats(fx.points(spark, sf_dir, 4.0))


@query
def voxel_centers(spark, sf_dir):
    return voxels.centers(voxels.voxelize(fx.points(spark, sf_dir), 8), 8)


@query
def grid_vertices(spark, sf_dir):
    """The grid's corners with the number of points nearest to each."""
    at = lambda a: F.round((F.col(a) + 0.5) * 6).cast("int")
    near = fx.points(spark, sf_dir, 2.0).groupBy(*[at(a).alias(n) for a, n in zip("xyz", "ijk", strict=True)]).agg(F.count(F.lit(1)).alias("n"))
    return voxels.grid_vertices(spark, 6).join(near, ["i", "j", "k"], "left").select("i", "j", "k", "x", "y", "z", F.coalesce("n", F.lit(0)).alias("n"))


@query
def voxel_query_points(spark, sf_dir):
    return voxels.query_points(voxels.voxelize(fx.points(spark, sf_dir, 4.0), 8), 8)


@query
def boundary_faces(spark, sf_dir):
    return voxels.boundary_faces(voxels.voxelize(fx.points(spark, sf_dir), 8))


@query
def boundary_triangles(spark, sf_dir):
    return voxels.boundary_triangles(voxels.voxelize(fx.points(spark, sf_dir), 8), 8)


@query
def l1_distances(spark, sf_dir):
    occupied = voxels.voxelize(fx.points(spark, sf_dir, 4.0), 8).withColumn("mask", F.lit(True))
    cells = voxels.grid(spark, 8).join(occupied, ["i", "j", "k"], "left").withColumn("mask", F.coalesce("mask", F.lit(False)))
    return voxels.l1_distance(cells, 8, "mask").select("i", "j", "k", F.col("distance").cast("int").alias("distance"))


@query
def free_labels(spark, sf_dir):
    occupied = voxels.voxelize(fx.points(spark, sf_dir, 4.0), 8)
    return voxels.labels(spark, 8, occupied.where("i < 4"), voxels.grid(spark, 8).join(occupied, ["i", "j", "k"], "left_anti"))


@query
def triangle_voxels(spark, sf_dir):
    return voxels.voxelize_triangles(fx.triangles(spark, sf_dir), 8)


@query
def bounding_box(spark, sf_dir):
    return filters.box(fx.points(spark, sf_dir))


@query
def expanded_box_points(spark, sf_dir):
    points = fx.points(spark, sf_dir)
    return filters.expanded_box(points, points.where("abs(x) < 0.15 and abs(y) < 0.15 and abs(z) < 0.15"), 0.05).select("point_id")


@query
def main_cluster_points(spark, sf_dir):
    return filters.main_cluster(fx.points(spark, sf_dir)).select("point_id")


@query
def face_normals(spark, sf_dir):
    return raster.face_normals(fx.triangles(spark, sf_dir)).select("face_id", *[r6(n, n) for n in ("nx", "ny", "nz")])


@query
def shaded_faces(spark, sf_dir):
    n = raster.face_normals(fx.triangles(spark, sf_dir))
    return n.select("face_id", r6(raster.shade(v.cols("nx", "ny", "nz"), [((0, 0, 1), 0.7), ((1, 1, 0), 0.4)], 0.3), "shade"))


def mesh(spark, sf_dir):
    """Boundary of the occupied voxels with shared corner vertices."""
    t = voxels.boundary_triangles(voxels.voxelize(fx.points(spark, sf_dir), 8), 8)
    vid = lambda m: sum((F.round((F.col(f"{a}{m}") + 0.5) * 8) * 9**k for k, a in enumerate("zyx")), F.lit(0.0)).cast("long")
    return t.withColumns({f"v{m}": vid(m) for m in range(3)})


@query
def vertex_normals(spark, sf_dir):
    return meshes.vertex_normals(mesh(spark, sf_dir)).select("vid", *[r6(n, n) for n in ("nx", "ny", "nz")])


@query
def surface_area(spark, sf_dir):
    return meshes.surface_area(fx.triangles(spark, sf_dir)).select(r6("area", "area"))


@query
def sanitized_mesh(spark, sf_dir):
    vertices = fx.points(spark, sf_dir).select(F.col("point_id").alias("vid"), F.when(F.col("point_id") % 50 == 7, float("nan")).otherwise(F.col("x")).alias("x"), "y", "z")
    n = F.lit(vertices.count())
    faces = vertices.select(F.col("vid").alias("face_id"), F.col("vid").alias("v0"), ((F.col("vid") * 7 + 1) % n).alias("v1"), ((F.col("vid") * 11 + 3) % (n + 5)).alias("v2"))
    return meshes.sanitize(vertices, faces)[1]


@query
def normalized_mesh(spark, sf_dir):
    return meshes.normalize(fx.points(spark, sf_dir)).select("point_id", *xyz(v.cols("x", "y", "z")))


def nearest_faces(spark, sf_dir, cameras):
    seen = raster.z_buffer(raster.fragments(fx.triangles(spark, sf_dir), cameras))
    return seen.groupBy("cam_idx", "face_id").agg(F.count(F.lit(1)).alias("pixels"), F.round(F.min("depth"), 5).alias("nearest"))


@query
def z_buffer(spark, sf_dir):
    return z_buffer_all(spark, sf_dir)


@query
def z_buffer_all(spark, sf_dir):
    return nearest_faces(spark, sf_dir, fx.cameras(spark, sf_dir))


@query
def texture_wrap(spark, sf_dir):
    at = F.col("x") * 20
    return fx.points(spark, sf_dir).select("point_id", *[r6(raster.wrap(at, m), m) for m in ("repeat", "mirror", "clamp")])


def spread(spark, sf_dir) -> int:
    """As many directions as there are points."""
    return fx.points(spark, sf_dir).count()


@query
def fibonacci_polars(spark, sf_dir):
    return generate.fibonacci_polars(spark, spread(spark, sf_dir)).select("idx", r6("phi", "phi"), r6("theta", "theta"))


@query
def fibonacci_directions(spark, sf_dir):
    return generate.fibonacci_directions(spark, spread(spark, sf_dir)).select("idx", *xyz(v.cols("x", "y", "z")))


@query
def azimuth_wedge(spark, sf_dir):
    """Points in a sector of azimuths around the z axis."""
    return fx.points(spark, sf_dir).where(generate.in_azimuth_wedge(F.atan2("y", "x"), pi / 3, 0.25)).select("point_id")


@query
def fill_ratio_fov(spark, sf_dir):
    """From every point the field of view in which a ball around the origin fills most of the image."""
    far = v.norm(v.cols("x", "y", "z"))
    return fx.points(spark, sf_dir, 5.0).select("point_id", r6(generate.fov_of_fill(0.5, far, 0.8, 10.0, 120.0), "fov"))


def paired(spark, sf_dir):
    p = fx.points(spark, sf_dir).withColumn("scene", F.col("point_id") % 3)
    return p.withColumns({"tx": 2 * F.col("y") + 0.5, "ty": -2 * F.col("x") + 0.25, "tz": 2 * F.col("z") - 1})


@query
def alignment_moments(spark, sf_dir):
    m = align.moments(paired(spark, sf_dir))
    return m.select("scene", "n", *[r6(n, n) for n in ("s_x", "s_tz", "p_x_x", "p_x_ty", "p_z_tz", "p_ty_tz")])


@query
def similarity_transform(spark, sf_dir):
    t = align.similarity(paired(spark, sf_dir))
    return t.select("scene", r6("scale", "scale"), *[r6(F.col("transform")[4 * i + j], f"t{i}{j}") for i in range(3) for j in range(4)])


@query
def affine_alignment(spark, sf_dir):
    t = align.affine(paired(spark, sf_dir))
    return t.select("scene", *[r6(F.col("linear")[3 * i + j], f"a{i}{j}") for i in range(3) for j in range(3)], *[r6(F.col("shift")[i], f"t{i}") for i in range(3)])


@query
def view_focus(spark, sf_dir):
    rays = fx.cameras(spark, sf_dir).select(F.lit(0).alias("scene"), *[x.alias(n) for x, n in zip((*c.position(), *c.forward()), ("x", "y", "z", "dx", "dy", "dz"), strict=True)])
    return align.focus_point(rays).select("scene", *xyz(v.cols("x", "y", "z")))


@query
def camera_sphere(spark, sf_dir):
    return normalize.cameras_sphere(fx.cameras(spark, sf_dir).withColumn("scene", F.lit(0))).select("scene", *xyz(v.cols("x", "y", "z")), r6("radius", "radius"))
