"""Registered queries of neighbours, order statistics, mesh repair, textures, resection and best places over the fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import camera as c
from ..functions import vector as v
from ..operators import framing, neighbours, quantiles, raster, resection, textures, winding
from ..sources import fixtures as fx
from .queries import Query, mesh, r6, xyz
from .scenes import entries, r5, seen_mesh

QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def numbered_points(spark, sf_dir) -> DataFrame:
    return fx.points(spark, sf_dir, 2.0).withColumnRenamed("point_id", "id")


@query
def point_neighbours(spark, sf_dir):
    p = numbered_points(spark, sf_dir)
    return neighbours.nearest(p, p, 5, digits=9).select("id", "rank", "near_id", r6("far2", "far2"))


@query
def point_normals(spark, sf_dir):
    return neighbours.estimated_normals(numbered_points(spark, sf_dir)).select("id", *[F.round(n, 3).alias(n) for n in ("nx", "ny", "nz")])


@query
def price_quantiles(spark, sf_dir):
    """Order statistics of whole groups of lineitem, some of a quarter of all rows."""
    shares = {"least": 0.0, "third": 1 / 3, "median": 0.5, "p95": 0.95, "most": 1.0}
    found = quantiles.quantiles(fx.read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", shares)
    return found.select("l_returnflag", "l_linestatus", *[F.round(n, 4).alias(n) for n in shares])


@query
def mesh_winding(spark, sf_dir):
    """The boundary mesh with every third face turned."""
    faces = mesh(spark, sf_dir).select("face_id", "v0", F.when(F.col("face_id") % 3 == 0, F.col("v2")).otherwise(F.col("v1")).alias("v1"), F.when(F.col("face_id") % 3 == 0, F.col("v1")).otherwise(F.col("v2")).alias("v2"))
    turned, _ = winding.orientation(faces)
    return turned.join(winding.wound(faces)[0], "face_id").select("face_id", "part", "flip", "v0", "v1", "v2")


@query
def textured_faces(spark, sf_dir):
    """Every triangle has texture places of its own: seams everywhere, repeated across, mirrored down."""
    seen, triangles = seen_mesh(spark, sf_dir)
    at = F.array(*[F.struct(F.lit(m).alias("corner"), (F.col(f"x{m}") * 3 + 0.5).alias("tu"), (F.col(f"y{m}") * 3 + F.col(f"z{m}")).alias("tv")) for m in range(3)])
    places = triangles.select("face_id", F.explode(at).alias("p")).select("face_id", "p.*")
    texture = fx.depth_pixels(spark, sf_dir).where("cam_idx = 0").select("row", "col", "conf")
    shown = textures.textured(seen, places, texture, 40, 25, ["conf"], ("repeat", "mirror"))
    return shown.groupBy("cam_idx", "face_id").agg(F.count(F.lit(1)).alias("pixels"), F.round(F.avg("conf"), 3).alias("conf"))


@query
def lit_vertex_colors(spark, sf_dir):
    """Colours of the boundary mesh's vertices, by their place, under one light."""
    t = mesh(spark, sf_dir)
    corners = t.select(F.explode(F.array(*[F.struct(F.col(f"v{m}").alias("vid"), *[(F.col(f"{a}{m}") + 0.5).alias(n) for a, n in zip("xyz", "rgb", strict=True)]) for m in range(3)])).alias("p")).select("p.*").distinct()
    shown = textures.render(t, fx.cameras(spark, sf_dir), ["rgb"], colors=corners, lights=(((0.3, -0.5, 0.8), 0.7),), ambient=0.3)["rgb"]
    return shown.groupBy("cam_idx").agg(*[F.round(F.avg(n), 5).alias(n) for n in "rgb"])


@query
def camera_resection(spark, sf_dir):
    """Cameras found anew from where they see the points; those behind a camera, and some lost, have no place."""
    truth = fx.cameras(spark, sf_dir, 1.2, 0.3)
    points = fx.points(spark, sf_dir, 2.0)
    pairs = c.project(points.join(F.broadcast(truth)), v.cols("x", "y", "z"))  # as many rows as nations
    pairs = pairs.select("cam_idx", "x", "y", "z", F.when(F.col("point_id") % 11 != 3, F.col("u")).alias("u"), F.when(F.col("point_id") % 13 != 4, F.col("v")).otherwise(float("nan")).alias("v"))
    found = resection.resection(pairs, truth.withColumns({"fovx_deg": F.lit(56.0), "w2c": F.lit(None).cast("array<double>")}), focal_weight=0.0)
    return found.select("cam_idx", F.round("fovx_deg", 4).alias("fovx"), *entries("w2c", 3, number=lambda x, n: F.round(x, 4).alias(n)))


@query
def best_camera_places(spark, sf_dir):
    moved = framing.best_positions(fx.cameras(spark, sf_dir, 2.5, 0.3), fx.points(spark, sf_dir, 2.0))
    return moved.select("cam_idx", *[r5(x, f"p{a}") for a, x in zip("xyz", c.position(), strict=True)])
