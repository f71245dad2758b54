"""Triangle meshes as vertex and face tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as v
from .filters import box, finite


def corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(face_id, x0 .. z2): faces joined with their three vertices; faces with an unknown vertex drop out."""
    out = faces.select("face_id", "v0", "v1", "v2")
    for m in range(3):
        out = out.join(vertices.select(F.col("vid").alias(f"v{m}"), *[F.col(a).alias(f"{a}{m}") for a in "xyz"]), f"v{m}")
    return out.select("face_id", "v0", "v1", "v2", *[f"{a}{m}" for m in range(3) for a in "xyz"])


def _area_vector() -> v.Vec:
    t = [v.cols(f"x{m}", f"y{m}", f"z{m}") for m in range(3)]
    return v.cross(v.sub(t[1], t[0]), v.sub(t[2], t[0]))


def surface_area(triangles: DataFrame) -> DataFrame:
    return triangles.agg(F.coalesce(F.sum(v.norm(_area_vector()) / 2), F.lit(0.0)).alias("area"))


def vertex_normals(triangles: DataFrame) -> DataFrame:
    """Unit sum of the area-weighted normals of each vertex's faces."""
    n = _area_vector()
    each = triangles.select(F.explode(F.array("v0", "v1", "v2")).alias("vid"), *[x.alias(f"n{a}") for x, a in zip(n, "xyz", strict=True)])
    total = each.groupBy("vid").agg(*[F.sum(f"n{a}").alias(f"n{a}") for a in "xyz"])
    return total.select("vid", *[x.alias(f"n{a}") for x, a in zip(v.unit(v.cols("nx", "ny", "nz")), "xyz", strict=True)])


def sanitize(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces without bad faces: those with a missing or non-finite vertex, a repeated index or no area. Kept
    vertices are numbered anew without gaps, in their order; numbers come from counts per range of old ones, so no
    partition sees them all."""
    good = corners(vertices.where(finite(*"xyz")), faces.where("v0 <> v1 and v1 <> v2 and v0 <> v2")).where(v.norm(_area_vector()) > 0)
    used = good.select(F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct()
    kept = vertices.join(used, "vid", "left_semi").withColumn("block", F.floor(F.col("vid") / 65536))
    before = kept.groupBy("block").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    numbered = kept.withColumn("at", F.row_number().over(Window.partitionBy("block").orderBy("vid"))).join(before, "block")
    numbered = numbered.withColumn("new_vid", F.col("at") - 1 + F.col("before")).drop("block", "at", "before")
    renamed = good.select("face_id", "v0", "v1", "v2")
    for m in range(3):
        renamed = renamed.join(numbered.select(F.col("vid").alias(f"v{m}"), F.col("new_vid").alias(f"w{m}")), f"v{m}")
    return numbered.drop("vid").withColumnRenamed("new_vid", "vid"), renamed.select("face_id", *[F.col(f"w{m}").alias(f"v{m}") for m in range(3)])


def normalize(vertices: DataFrame, size: float = 0.99) -> DataFrame:
    """Centred on the box's middle and scaled so that its longest side has this size."""
    b = box(vertices)
    longest = F.greatest(*[F.col(f"hi_{a}") - F.col(f"lo_{a}") for a in "xyz"])
    moved = [((F.col(a) - (F.col(f"lo_{a}") + F.col(f"hi_{a}")) / 2) * F.when(longest > 0, size / F.nullif(longest, F.lit(0.0))).otherwise(1.0)).alias(a) for a in "xyz"]
    return vertices.join(F.broadcast(b)).select(*[c for c in vertices.columns if c not in "xyz"], *moved)  # b is one row


def normalize_half(vertices: DataFrame, scale: float = 1.0) -> DataFrame:
    """Centred on the box's middle and scaled so that half its longest side has this size."""
    return normalize(vertices, 2 * scale)


def sample_count(area: float, r: int, per_voxel: float = 2.0, most: int = 8_000_000) -> int:
    """Samples that cover a surface on a grid of r voxels a side: twice the area in squares of 1 / (per_voxel * r), at least as many
    as one face of the cube has, at most the given number."""
    grid = (per_voxel * r) ** 2
    return int(min(most, max(grid, -(-2 * area * grid // 1))))


def sample_surface(triangles: DataFrame, n: int, seed: int) -> DataFrame:
    """n random points of the surface, each triangle by its area: the whole part of its share of the n, and one more for the
    triangles with the largest rests, of equals the smaller face_id. Points are generated where their triangle stands, so no task
    sees all triangles. Of triangles without area there are none."""
    from ..storage import kept
    from .quantiles import places

    area = v.norm(_area_vector()) / 2
    rows = triangles.select("face_id", *[f"{a}{m}" for m in range(3) for a in "xyz"], area.alias("area")).where("area > 0")
    whole = rows.agg(F.sum("area")).first()[0] or 1.0
    want = F.col("area") * (n / whole)
    rows = kept(rows.withColumns({"k": F.floor(want), "rest": want - F.floor(want)}), "shares")
    faces, given = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("k"), F.lit(0))).first()
    missing = min(faces, max(0, n - given))
    if missing:
        at = rows.sparkSession.createDataFrame([(faces - missing,)], "place long")
        edge = places(rows, [], "rest", at).first()["value"]
        above = rows.where(F.col("rest") > edge).count()
        ties = rows.where(F.col("rest") == edge).select("face_id").orderBy("face_id").limit(missing - above).withColumn("tie", F.lit(1))
        rows = rows.join(ties, "face_id", "left").withColumn("k", F.col("k") + (F.col("rest") > edge).cast("int") + F.coalesce("tie", F.lit(0)))
    rows = rows.where("k > 0").withColumn("k", F.col("k").cast("int"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(1), F.col("k")))).withColumns({"_a": F.sqrt(F.rand(seed + 1)), "_b": F.rand(seed + 2)})
    w = (1 - F.col("_a"), F.col("_a") * (1 - F.col("_b")), F.col("_a") * F.col("_b"))
    return rows.select("face_id", *[sum((w[m] * F.col(f"{a}{m}") for m in range(3)), F.lit(0.0)).alias(a) for a in "xyz"])


def frustum_corners(cameras: DataFrame, far: float = 1.0) -> DataFrame:
    """(cam_idx, corner, x, y, z): each camera's centre (0) and where the image's corners lie in this depth, from the lower left
    one around (1 to 4)."""
    from ..functions import camera as c

    places = F.array(*[F.struct(F.lit(k + 1).alias("corner"), F.lit(float(a)).alias("u"), F.lit(float(b)).alias("v")) for k, (a, b) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))])
    rows = cameras.withColumn("p", F.explode(places))
    around = rows.select("cam_idx", "p.corner", *[x.alias(n) for x, n in zip(c.back_project(F.col("p.u"), F.col("p.v"), F.lit(float(far))), "xyz", strict=True)])
    return around.unionByName(cameras.select("cam_idx", F.lit(0).alias("corner"), *[x.alias(n) for x, n in zip(c.position(), "xyz", strict=True)]))


def line_set(a: DataFrame, b: DataFrame, key: str | None = None) -> DataFrame:
    """Segments (x0 .. z1) between points: by a common key (one to one, or each key's points with all others of it), or from
    the single point of a to every point of b."""
    ends = a.select(*([key] if key else []), *[F.col(n).alias(f"{n}0") for n in "xyz"])
    to = b.select(*([key] if key else []), *[F.col(n).alias(f"{n}1") for n in "xyz"])
    if key:
        return ends.join(to, key)
    if ends.limit(2).count() > 1:
        raise ValueError("without a key the first side is one point")
    return to.join(F.broadcast(ends))  # one row


def merge(parts: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """One mesh of several: vertex and face numbers of each part follow those of the parts before it."""
    vs, fs, v_at, f_at = [], [], 0, 0
    for vertices, faces in parts:
        vs.append(vertices.withColumn("vid", F.col("vid") + v_at))
        fs.append(faces.select((F.col("face_id") + f_at).alias("face_id"), *[(F.col(f"v{m}") + v_at).alias(f"v{m}") for m in range(3)]))
        v_at += vertices.agg(F.coalesce(F.max("vid") + 1, F.lit(0))).first()[0]
        f_at += faces.agg(F.coalesce(F.max("face_id") + 1, F.lit(0))).first()[0]
    return reduce(DataFrame.unionByName, vs), reduce(DataFrame.unionByName, fs)
