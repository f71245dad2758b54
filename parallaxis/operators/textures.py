"""Colour of rendered meshes: values of face corners, textures, materials by normal, light, background; several kinds at once.

A corner's value belongs to a face, not to a vertex, so a texture may have seams: two faces that share a vertex look up
different places for it. Pixels know their face and its corners' weights, which went through the near cut, so a value is one
join on the face; a texel is one on its place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as v
from ..storage import kept
from . import meshes, raster, small

RGB = ("r", "g", "b")
Lights = Sequence[tuple[tuple[float, float, float], float]]
KINDS = ("mask", "depth", "normal", "rgb", "matcap")


def corner_table(values: DataFrame, names: Sequence[str]) -> DataFrame:
    """(face_id, {name}_0, {name}_1, {name}_2) of rows (face_id, corner, names), for faces that have all three corners."""
    picked = [F.max(F.when(F.col("corner") == m, F.col(n))).alias(f"{n}_{m}") for n in names for m in range(3)]
    return values.groupBy("face_id").agg(F.count_distinct("corner").alias("_n"), *picked).where("_n = 3").drop("_n")


def mixed(seen: DataFrame, table: DataFrame, names: Sequence[str]) -> DataFrame:
    """Seen pixels whose face is in the table, with the corners' values mixed by the pixel's weights."""
    rows = seen.join(table.select("face_id", *[f"{n}_{m}" for n in names for m in range(3)]), "face_id")
    first = 1 - F.col("b1") - F.col("b2")
    return rows.select(*seen.columns, *[(first * F.col(f"{n}_0") + F.col("b1") * F.col(f"{n}_1") + F.col("b2") * F.col(f"{n}_2")).alias(n) for n in names])


def from_vertices(faces: DataFrame, vertices: DataFrame, names: Sequence[str]) -> DataFrame:
    """The corner table of values that belong to vertices (vid, names)."""
    out = faces.select("face_id", "v0", "v1", "v2")
    for m in range(3):
        out = out.join(vertices.select(F.col("vid").alias(f"v{m}"), *[F.col(n).alias(f"{n}_{m}") for n in names]), f"v{m}")
    return out.select("face_id", *[f"{n}_{m}" for n in names for m in range(3)])


def textured(seen: DataFrame, places: DataFrame, texture: DataFrame, width: int, height: int, names: Sequence[str] = RGB, wrap: tuple[str, str] = ("clamp", "clamp")) -> DataFrame:
    """Seen pixels with the texture's values. places: (face_id, corner, tu, tv), tv upwards; texture: (row, col, names), row 0 at
    the top. Places that are not finite are 0. Pixels of faces without places have none and are left out."""
    sound = lambda n: F.when(F.isnan(n) | (F.abs(n) == float("inf")), 0.0).otherwise(F.coalesce(n, F.lit(0.0))).alias(n)
    table = corner_table(places.select("face_id", "corner", sound("tu"), sound("tv")), ("tu", "tv"))
    return raster.sample_bilinear(mixed(seen, table, ("tu", "tv")), texture, width, height, list(names), wrap).drop("tu", "tv")


def smooth_normals(seen: DataFrame, triangles: DataFrame) -> DataFrame:
    """Seen pixels with the unit normal (nx, ny, nz) mixed of their face's vertices' normals."""
    normals = meshes.vertex_normals(triangles)
    rows = mixed(seen, from_vertices(triangles, normals, ("nx", "ny", "nz")), ("nx", "ny", "nz"))
    return rows.withColumns(dict(zip(("nx", "ny", "nz"), v.unit(v.cols("nx", "ny", "nz")), strict=True)))


def matcap(seen: DataFrame, triangles: DataFrame, cameras: DataFrame, texture: DataFrame, width: int, height: int, names: Sequence[str] = RGB) -> DataFrame:
    """Seen pixels with the material's values at the place that their normal in the camera's frame names."""
    rows = smooth_normals(seen, triangles).join(small(cameras.select("cam_idx", "w2c")), "cam_idx")
    u, w = raster.matcap_place(v.apply(v.matrix("w2c"), v.cols("nx", "ny", "nz"), translate=False))
    return raster.sample_bilinear(rows.select(*seen.columns, u.alias("tu"), w.alias("tv")), texture, width, height, list(names)).drop("tu", "tv")


def lit(colored: DataFrame, normals: DataFrame, lights: Lights, ambient: float, names: Sequence[str] = RGB) -> DataFrame:
    """Colours under lights of these directions and strengths; normals: (cam_idx, row, col, nx, ny, nz)."""
    rows = colored.join(normals.select("cam_idx", "row", "col", "nx", "ny", "nz"), ["cam_idx", "row", "col"])
    light = raster.shade(v.cols("nx", "ny", "nz"), list(lights), ambient)
    return rows.withColumns({n: F.col(n) * light for n in names}).drop("nx", "ny", "nz")


def render(
    triangles: DataFrame, cameras: DataFrame, kinds: Sequence[str] = ("mask", "rgb", "depth", "normal"), places: DataFrame | None = None, texture: tuple[DataFrame, int, int] | None = None, wrap: tuple[str, str] = ("clamp", "clamp"),
    colors: DataFrame | None = None, paint: tuple[float, float, float] = (0.5, 0.5, 0.5), lights: Lights | None = (((1.0, 1.0, 1.0), 0.7),), ambient: float = 0.3, background: float = 1.0,
) -> dict[str, DataFrame]:
    """Rasters (cam_idx, row, col, values) of every pixel of every camera, by kind, from one rendering. rgb: from the texture at the
    corners' places, else from the vertices' colours (vid, r, g, b), else painted; lit unless lights is None; 0 to 1, background
    where nothing is seen. matcap: the texture by normal. triangles: (face_id, v0-v2, x0-z2)."""
    unknown = set(kinds) - set(KINDS)
    if unknown:
        raise ValueError(f"no such kinds: {sorted(unknown)}")
    seen = kept(raster.z_buffer(raster.fragments(triangles, cameras)), "seen")
    pixels = seen.select("cam_idx", "row", "col", "face_id", "b1", "b2")
    blank = dict.fromkeys(RGB, background)
    out: dict[str, DataFrame] = {}
    if "mask" in kinds:
        out["mask"] = raster.render_mask(seen, cameras)
    if "depth" in kinds:
        out["depth"] = raster.render_depth(seen, cameras)
    if "normal" in kinds or ("rgb" in kinds and lights is not None):
        normals = kept(smooth_normals(pixels, triangles), "normals")
    if "normal" in kinds:
        out["normal"] = raster.on_background(normals, cameras, dict.fromkeys(("nx", "ny", "nz"), 0.0))
    if "matcap" in kinds:
        if texture is None:
            raise ValueError("matcap needs a texture")
        out["matcap"] = raster.on_background(matcap(pixels, triangles, cameras, *texture), cameras, blank)
    if "rgb" in kinds:
        if texture is not None and places is not None:
            colored = textured(pixels, places, *texture, wrap=wrap)
        elif colors is not None:
            colored = mixed(pixels, from_vertices(triangles, colors, RGB), RGB)
        else:
            colored = pixels.select("*", *[F.lit(float(x)).alias(n) for n, x in zip(RGB, paint, strict=True)])
        out["rgb"] = raster.on_background(colored if lights is None else lit(colored, normals, lights, ambient), cameras, blank)
    return out
