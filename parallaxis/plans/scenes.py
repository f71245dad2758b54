"""Registered queries of camera lists, channels, rendering and generators over the derived fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import camera as c
from ..functions import vector as v
from ..operators import align, generate, images, matching, meshes, normalize, raster, small
from ..sources import fixtures as fx
from .queries import Query, mesh, paired, r6, spread, xyz
from .visible import mark_visible

QUERIES: dict[str, Query] = {}
XYZ = ("x", "y", "z")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def entries(column: str, rows: int, names: str = "m", width: int = 4, number=r6):
    return [number(F.col(column)[width * i + j], f"{names}{i}{j}") for i in range(rows) for j in range(width)]


def r5(x, name: str):
    """Unit vectors are made with a small number added to their length, which the sixth digit may show."""
    return (F.round(F.col(x) if isinstance(x, str) else x, 5) + F.lit(0.0)).alias(name)


def rig(spark, sf_dir) -> DataFrame:
    """Cameras of two scenes."""
    return fx.cameras(spark, sf_dir, phase=0.3).withColumn("scene", F.col("cam_idx") % 2)


def turned(spark) -> DataFrame:
    """A similarity: a quarter turn about z, scale 2, a shift."""
    m = F.array(*[F.lit(float(x)) for x in (0, -2, 0, 1, 2, 0, 0, -0.5, 0, 0, 2, 0.25, 0, 0, 0, 1)])
    return spark.range(2).select(F.col("id").cast("int").alias("scene"), m.alias("transform"))


def holed(spark, sf_dir) -> DataFrame:
    """Depth pixels of which every seventh has no valid depth."""
    return fx.depth_pixels(spark, sf_dir).withColumn("depth", F.when((F.col("row") * 40 + F.col("col")) % 7 == 3, 0.0).otherwise(F.col("depth")))


@query
def camera_intrinsic_matrix(spark, sf_dir):
    return fx.cameras(spark, sf_dir).select("cam_idx", c.intrinsic_matrix().alias("k")).select("cam_idx", *entries("k", 3, "k", 3))


@query
def camera_from_matrices(spark, sf_dir):
    rows = fx.cameras(spark, sf_dir).select("cam_idx", c.flip("w2c", c.CAMERA_FRAME).alias("e"), c.intrinsic_matrix().alias("k"))
    back = c.from_matrices(rows, "e", "k", c.CAMERA_FRAME)
    return back.select("cam_idx", "width", "height", r6("fovx_deg", "fovx"), F.col("fovy_deg").isNull().alias("square"), *entries("w2c", 3))


@query
def camera_resized(spark, sf_dir):
    rows = c.with_size(c.with_fov(fx.cameras(spark, sf_dir), 40 + F.col("cam_idx").cast("double")), 200, 100)
    return rows.select("cam_idx", r6(c.fx(), "fx"), r6(c.fy(), "fy"), "cx", "cy")


@query
def points_span(spark, sf_dir):
    return normalize.points_span(fx.points(spark, sf_dir)).select(*[r6(n, n) for n in ("mx", "my", "mz", "radius")])


@query
def focused_cameras(spark, sf_dir):
    at = normalize.focus_on_points(fx.cameras(spark, sf_dir, phase=0.3), fx.points(spark, sf_dir))
    return at.select("cam_idx", *[r5(x, f"{k}{a}") for k, t in (("p", c.position()), ("f", c.forward())) for a, x in zip(XYZ, t, strict=True)])


@query
def transformed_cameras(spark, sf_dir):
    moved = normalize.transform_cameras(rig(spark, sf_dir), turned(spark))
    return moved.select("cam_idx", r6("scale", "scale"), *xyz(c.position(), "p"), *xyz(c.forward(), "f"), *xyz(c.up(), "u"))


@query
def transformed_depths(spark, sf_dir):
    moved = normalize.transform_cameras(fx.cameras(spark, sf_dir).withColumn("scene", F.col("cam_idx") % 2), turned(spark))
    return normalize.transform_depths(fx.depth_pixels(spark, sf_dir), moved).groupBy("cam_idx").agg(r6(F.sum("depth"), "total"))


@query
def similarity_inverse(spark, sf_dir):
    """Similarities fitted to pairs of points, taken apart and inverted."""
    parts = normalize.similarity_parts(align.similarity(paired(spark, sf_dir)))
    return parts.select("scene", r6("scale", "scale"), *entries("rotation", 3, "r", 3), *entries("inverse", 3))


@query
def mean_up_frame(spark, sf_dir):
    return normalize.axis_transform(rig(spark, sf_dir)).select("scene", *entries("transform", 3, number=r5))


@query
def cluster_up_frame(spark, sf_dir):
    return normalize.axis_transform(rig(spark, sf_dir), "cluster", cluster_deg=60.0, least_share=0.1).select("scene", *entries("transform", 3, number=r5))


def off_sphere(spark, sf_dir) -> DataFrame:
    """A rig off its sphere, some cameras by far."""
    rows = rig(spark, sf_dir)
    far = F.when(F.col("cam_idx") % 11 == 5, 1.5).otherwise(1 + (F.col("cam_idx") % 5) / F.lit(100.0))
    return rows.withColumn("w2c", c.pose(c.rotation()[0], c.up(), c.rotation()[2], v.scale(c.position(), far)))


@query
def camera_sphere_fit(spark, sf_dir):
    return normalize.cameras_sphere(off_sphere(spark, sf_dir)).select("scene", *[r5(n, n) for n in (*XYZ, "radius")])


@query
def sphere_frame(spark, sf_dir):
    return normalize.sphere_transform(off_sphere(spark, sf_dir)).select("scene", *entries("transform", 3, number=r5))


@query
def image_order(spark, sf_dir):
    """Scene 0 has the references' ids in another order, scene 1 one id twice."""
    rows = rig(spark, sf_dir)
    names = rows.select("scene", "cam_idx", F.concat(F.lit("im"), F.col("cam_idx")).alias("image_id"))
    mixed = names.select("scene", (24 - F.col("cam_idx")).alias("cam_idx"), F.when((F.col("scene") == 1) & (F.col("cam_idx") == 3), "im5").otherwise(F.col("image_id")).alias("image_id"))
    return normalize.image_order(mixed, names)


@query
def scene_radii(spark, sf_dir):
    return matching.radii(rig(spark, sf_dir)).join(matching.view_angles(rig(spark, sf_dir)), "scene").select("scene", r6("radius", "radius"), F.round("spread", 4).alias("spread"))


@query
def depth_view(spark, sf_dir):
    return images.normalized(holed(spark, sf_dir), "depth", "shade", images.valid_depth() & F.col("mask")).select("cam_idx", "row", "col", r6("shade", "shade"))


@query
def masked_depth(spark, sf_dir):
    return images.masked(images.inside_depth(holed(spark, sf_dir), 0.5), ["depth"]).select("cam_idx", "row", "col", "depth")


@query
def world_colors(spark, sf_dir):
    inside = images.inside_depth(holed(spark, sf_dir))
    at = images.world_points(inside, fx.cameras(spark, sf_dir), 40, 25).join(inside.select("cam_idx", "row", "col", "inside"), ["cam_idx", "row", "col"])
    return images.point_colors(at).select("cam_idx", "row", "col", *[r6(n, n) for n in XYZ])


@query
def depth_cloud(spark, sf_dir):
    colors = fx.depth_pixels(spark, sf_dir).select("cam_idx", "row", "col", *[(F.col("conf") / k).alias(n) for k, n in ((500, "r"), (600, "g"), (700, "b"))])
    cloud = images.depth_cloud(holed(spark, sf_dir), fx.cameras(spark, sf_dir), 40, 25, colors=colors)
    return cloud.select("cam_idx", "row", "col", *xyz(v.cols(*XYZ)), "conf", r6("r", "r"))


@query
def resampled_mask(spark, sf_dir):
    return images.resample(fx.depth_pixels(spark, sf_dir).select("cam_idx", "row", "col", "mask"), 40, 25, 57, 31).select("cam_idx", "row", "col", "mask")


@query
def resized_confidence(spark, sf_dir):
    return images.resize(fx.depth_pixels(spark, sf_dir), 40, 25, 57, 31, ["conf"]).select("cam_idx", "row", "col", F.round("conf", 4).alias("conf"))


@query
def queried_pixels(spark, sf_dir):
    e = F.col("event_id")
    at = fx.read(spark, sf_dir, "events").select(F.floor(e / 1000).cast("int").alias("cam_idx"), e.alias("id"), ((e * 37 % 1009) / F.lit(1009.0)).alias("u"), ((e * 53 % 997) / F.lit(997.0)).alias("v"))
    found = images.query_pixels(at, holed(spark, sf_dir), fx.cameras(spark, sf_dir), 40, 25)
    return found.select("id", *xyz(v.cols(*XYZ)), "conf", "valid")


@query
def camera_normals(spark, sf_dir):
    n = fx.depth_pixels(spark, sf_dir).select("cam_idx", "row", "col", "mask", *[x.alias(a) for x, a in zip(v.unit((F.col("conf") - 200, F.col("row") - 12.2, F.col("col") - 19.7)), ("nx", "ny", "nz"), strict=True)])
    return images.normal_colors(images.turn_normals(n, fx.cameras(spark, sf_dir), to_world=False)).select("cam_idx", "row", "col", *[r6(a, a) for a in ("nx", "ny", "nz")])


@query
def foreground_boxes(spark, sf_dir):
    pixels = fx.depth_pixels(spark, sf_dir).select("cam_idx", "row", "col", F.when(F.col("conf") > 300, F.col("conf") / 500).otherwise(1.0).alias("r"))
    return images.foreground(pixels, 40, 25, {"r": 1.0}, 40, 1).select("cam_idx", "row", "col", r6("r", "r"))


@query
def unpadded_images(spark, sf_dir):
    places = fx.cameras(spark, sf_dir).select("cam_idx", (F.col("cam_idx") % 7).alias("x1"), (F.col("cam_idx") % 5).alias("y1"), (30 + F.col("cam_idx") % 10).alias("x2"), (20 + F.col("cam_idx") % 3).alias("y2"))
    return images.unpad(fx.depth_pixels(spark, sf_dir).select("cam_idx", "row", "col", "conf"), places)


def seen_mesh(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """What all cameras see of the triangles, and the triangles."""
    triangles = fx.triangles(spark, sf_dir)
    return raster.z_buffer(raster.fragments(triangles, fx.cameras(spark, sf_dir))), triangles


@query
def rendered_normals(spark, sf_dir):
    seen, triangles = seen_mesh(spark, sf_dir)
    shown = raster.render_normals(seen, triangles, fx.cameras(spark, sf_dir))
    return shown.groupBy("cam_idx").agg(F.count(F.lit(1)).alias("pixels"), *[F.round(F.avg(n), 5).alias(n) for n in ("nx", "ny", "nz", "mx", "my", "mz")])


@query
def rendered_corners(spark, sf_dir):
    """Corner values 0, 1 and 2 mixed by the pixels' weights."""
    seen, _ = seen_mesh(spark, sf_dir)
    return seen.groupBy("cam_idx", "face_id").agg(F.round(F.avg(F.col("b1") + 2 * F.col("b2")), 5).alias("mixed"))


@query
def vertex_colors(spark, sf_dir):
    """A mesh's vertices coloured by their place: where a pixel shows the mesh, its colour is its place."""
    t = mesh(spark, sf_dir)
    cameras = fx.cameras(spark, sf_dir)
    seen = raster.z_buffer(raster.fragments(t, cameras))
    vertices = t.select(F.explode(F.array(*[F.struct(F.col(f"v{m}").alias("vid"), *[F.col(f"{a}{m}").alias(a) for a in XYZ]) for m in range(3)])).alias("p")).select("p.*").distinct()
    shown = raster.interpolate(seen, t, vertices, list(XYZ)).join(small(cameras), "cam_idx")
    u, w = (F.col("col") + 0.5) / F.col("width"), 1 - (F.col("row") + 0.5) / F.col("height")
    # a pixel's centre lies half a pixel before the place that projects there
    at = c.back_project(u + 0.5 / F.col("width"), w + 0.5 / F.col("height"), F.col("depth"))
    off = v.norm(v.sub(v.cols(*XYZ), at))
    return shown.groupBy("cam_idx").agg((F.max(off) < 1e-6).alias("exact"))


@query
def camera_sees_any(spark, sf_dir):
    seen, _ = seen_mesh(spark, sf_dir)
    return raster.shows_any(seen, fx.cameras(spark, sf_dir))


@query
def textured_points(spark, sf_dir):
    texture = fx.depth_pixels(spark, sf_dir).where("cam_idx = 0").select("row", "col", "conf")
    at = fx.points(spark, sf_dir).select("point_id", (F.col("x") * 3 + 0.5).alias("tu"), (F.col("y") * 3 + 0.5).alias("tv"))
    return raster.sample_bilinear(at, texture, 40, 25, ["conf"], "repeat").select("point_id", F.round("conf", 4).alias("conf"))


@query
def frustum_corners(spark, sf_dir):
    return meshes.frustum_corners(fx.cameras(spark, sf_dir), 2.0).select("cam_idx", "corner", *xyz(v.cols(*XYZ)))


@query
def line_segments(spark, sf_dir):
    p = paired(spark, sf_dir).select("point_id", *XYZ)
    return meshes.line_set(p, p.select("point_id", *[(F.col(n) + k).alias(n) for k, n in enumerate(XYZ)]), "point_id").select("point_id", *[r6(f"{n}{k}", f"{n}{k}") for k in range(2) for n in XYZ])


@query
def fibonacci_rotations(spark, sf_dir):
    return generate.fibonacci_rotations(spark, spread(spark, sf_dir)).select("idx", *entries("rotation", 3, "r", 3))


@query
def mark_visible_masked(spark, sf_dir):
    """All five inputs: points, triangles, masks and unknown points; depth is the candidates' where neither is given."""
    masks = fx.depth_pixels(spark, sf_dir).select("cam_idx", "row", "col", "mask")
    unknown = fx.points(spark, sf_dir, 3.0)
    labels = mark_visible(fx.points(spark, sf_dir, 2.0), fx.cameras(spark, sf_dir), 8, triangles=fx.triangles(spark, sf_dir), masks=masks, unknown=unknown, size=(40, 25))
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query
def mark_visible_depth(spark, sf_dir):
    labels = mark_visible(None, fx.cameras(spark, sf_dir), 8, depth=holed(spark, sf_dir), size=(40, 25))
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
