"""Faces that turn the same way, and meshes made fit to render.

Two faces that share an edge, which no third face has, turn the same way if they run along it in opposite directions. So every
such edge says whether its two faces agree, and a connected part of the mesh has one way to turn all its faces like its face
of the smallest id, unless its edges contradict each other (as on a one-sided surface), which is reported. Parts are found by
hooking each one to its smallest neighbour, shortening the chains by doubling, and contracting what was hooked, with the
agreement of a face with its part's first carried along as a parity: rounds grow with the logarithm of the faces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as v
from ..storage import kept
from .filters import finite
from .meshes import corners, sanitize, vertex_normals


def shared_edges(faces: DataFrame) -> DataFrame:
    """(a, b, odd): pairs of faces, a < b, with an edge that only they have, and whether they run along it in one direction."""
    ends = F.array(*[F.struct(F.col(f"v{m}").alias("s"), F.col(f"v{(m + 1) % 3}").alias("t")) for m in range(3)])
    sides = faces.select("face_id", F.explode(ends).alias("e")).select("face_id", F.least("e.s", "e.t").alias("lo"), F.greatest("e.s", "e.t").alias("hi"), (F.col("e.s") < F.col("e.t")).cast("int").alias("up"))
    met = sides.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.min("face_id").alias("a"), F.max("face_id").alias("b"), F.sum("up").alias("ups"))
    return met.where("n = 2 and a < b").select("a", "b", (F.col("ups") != 1).cast("int").alias("odd")).distinct()


def parts(faces: DataFrame, links: DataFrame) -> DataFrame:
    """(face_id, part: the smallest face connected with it, odd: 1 if the links say that it turns unlike that face)."""
    labels = kept(faces.select("face_id", F.col("face_id").alias("part"), F.lit(0).alias("odd")), "labels")
    edges = kept(links.select("a", "b", "odd"), "links")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "odd"))
        up = both.groupBy("a").agg(F.min(F.struct("b", "odd")).alias("n"))
        lower = F.col("n.b") < F.col("a")
        up = kept(up.select(F.col("a").alias("node"), F.when(lower, F.col("n.b")).otherwise(F.col("a")).alias("up"), F.when(lower, F.col("n.odd")).otherwise(0).alias("odd")), "hooks")
        while True:
            over = up.select(F.col("node").alias("up"), F.col("up").alias("top"), F.col("odd").alias("more"))
            longer = kept(up.join(over, "up").select("node", F.col("top").alias("up"), F.col("odd").bitwiseXOR(F.col("more")).alias("odd"), (F.col("top") != F.col("up")).alias("moved")), "hooks")
            up = longer.drop("moved")
            if longer.where("moved").isEmpty():
                break
        at = lambda p: up.select(F.col("node").alias(p), F.col("up").alias(f"{p}_up"), F.col("odd").alias(f"{p}_odd"))
        moved = labels.join(at("part"), "part", "left")
        labels = kept(moved.select("face_id", F.coalesce("part_up", "part").alias("part"), F.col("odd").bitwiseXOR(F.coalesce("part_odd", F.lit(0))).alias("odd")), "labels")
        ends = edges.join(at("a"), "a").join(at("b"), "b").where("a_up <> b_up")
        ends = ends.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b"), F.col("odd").bitwiseXOR(F.col("a_odd")).bitwiseXOR(F.col("b_odd")).alias("odd"))
        edges = kept(ends.groupBy("a", "b").agg(F.min("odd").alias("odd")), "links")
    return labels


def orientation(faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(face_id, part, flip), and (part, conflicts): the links of each part that its faces, once flipped, still break. Parts
    without any are left out of the second table. faces: (face_id, v0, v1, v2), ids distinct."""
    links = kept(shared_edges(faces), "shared-edges")
    found = parts(faces, links)
    side = lambda p: found.select(F.col("face_id").alias(p), F.col("part").alias("part"), F.col("odd").alias(f"{p}_odd"))
    broken = links.join(side("a"), "a").join(side("b").drop("part"), "b").where(F.col("a_odd").bitwiseXOR(F.col("b_odd")) != F.col("odd"))
    return found.select("face_id", "part", (F.col("odd") == 1).alias("flip")), broken.groupBy("part").agg(F.count(F.lit(1)).alias("conflicts"))


def wound(faces: DataFrame, corner_values: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Faces that turn alike, and values of their corners (face_id, corner 0-2, ...) that went with them. A flipped face keeps its
    first corner."""
    turned, _ = orientation(faces)
    some = turned.where("flip").select("face_id", F.lit(True).alias("flip"))
    rows = faces.join(some, "face_id", "left")
    out = rows.withColumns({"v1": F.when(F.col("flip"), F.col("v2")).otherwise(F.col("v1")), "v2": F.when(F.col("flip"), F.col("v1")).otherwise(F.col("v2"))}).select(*faces.columns)
    if corner_values is None:
        return out, None
    values = corner_values.join(faces.select("face_id"), "face_id", "left_semi").join(some, "face_id", "left")
    return out, values.withColumn("corner", F.when(F.col("flip") & (F.col("corner") > 0), 3 - F.col("corner")).otherwise(F.col("corner")).cast("int")).select(*corner_values.columns)


def post_process(vertices: DataFrame, faces: DataFrame, corner_values: DataFrame | None = None, fix_winding: bool = True) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Vertices, faces and corner values fit to render: without bad faces and unused vertices (`meshes.sanitize`), all faces of a
    part turned alike, every vertex with a unit normal. Columns of the vertices beside their place stay with them; texture
    places (tu, tv) that are not finite become 0 or 1. A vertex whose faces' normals cancel out looks somewhere fixed."""
    vertices, faces = sanitize(vertices, faces)
    vertices, faces = kept(vertices, "vertices"), kept(faces, "faces")
    if fix_winding:
        faces, corner_values = wound(faces, corner_values)
        faces = kept(faces, "wound")
    elif corner_values is not None:
        corner_values = corner_values.join(faces.select("face_id"), "face_id", "left_semi")

    def clean(df: DataFrame | None) -> DataFrame | None:
        if df is None:
            return None
        sound = lambda t: F.when(F.col(t) == float("inf"), 1.0).when(finite(t), F.col(t)).otherwise(0.0)
        return df.withColumns({t: sound(t) for t in ("tu", "tv") if t in df.columns})

    normals = vertex_normals(corners(vertices, faces))
    # any unit vector will do; two numbers from the vertex's id place it on the sphere
    part = lambda k: F.pmod(F.xxhash64(F.lit(k), "vid"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    up, around = 2 * part(1) - 1, part(2) * 6.283185307179586
    level = F.sqrt(1 - up * up)
    spare = (level * F.cos(around), level * F.sin(around), up)
    rows = vertices.drop("nx", "ny", "nz").join(normals, "vid", "left")
    good = finite("nx", "ny", "nz") & (v.norm(v.cols("nx", "ny", "nz")) >= 1e-12)
    return clean(rows.withColumn("_ok", good).withColumns({f"n{a}": F.when(F.col("_ok"), F.col(f"n{a}")).otherwise(x) for a, x in zip("xyz", spare, strict=True)}).drop("_ok")), faces, clean(corner_values)
