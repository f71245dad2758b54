"""Voxel grids over the cube [-0.5, 0.5]^3: (x, y, z) goes to (i, j, k) = floor((p + 0.5) R)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vector as v
from .filters import in_bounds

UNKNOWN, VALID = 0, 1
IJK = ("i", "j", "k")


def _side(axis: int, ahead: bool) -> tuple[tuple[int, ...], tuple[tuple[int, ...], ...]]:
    """Outward direction and corners, counter-clockwise as seen from outside, of one face of a voxel: around the square of
    the two axes that follow, one way or the other."""
    ring = [(0, 0), (1, 0), (1, 1), (0, 1)]
    corners = []
    for u, w in ring if ahead else [ring[0], *ring[:0:-1]]:
        at = {axis: int(ahead), (axis + 1) % 3: u, (axis + 2) % 3: w}
        corners.append(tuple(at[a] for a in range(3)))
    return tuple((1 if ahead else -1) * int(a == axis) for a in range(3)), tuple(corners)


#: The faces of a voxel, numbered by axis, the one ahead first.
FACES = tuple(_side(axis, ahead) for axis in range(3) for ahead in (True, False))
#: Voxels along each side of the blocks in which triangles are looked for first.
BLOCK = 8


def resolution(r) -> int:
    """A positive whole number; booleans and fractions are refused."""
    if isinstance(r, bool) or int(r) != r or r <= 0:
        raise ValueError(f"resolution must be a positive whole number, not {r!r}")
    return int(r)


def free_label(k: int) -> int:
    if isinstance(k, bool) or int(k) != k or k < 1:
        raise ValueError(f"free level must be a positive whole number, not {k!r}")
    return -int(k)


def free_without_bound(r: int) -> int:
    return -3 * resolution(r)


def index(p: Column, r: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(r - 1), F.floor((p + 0.5) * r))).cast("int")


def voxelize(points: DataFrame, r: int) -> DataFrame:
    """Distinct voxels of the finite points inside the cube."""
    r = resolution(r)
    return in_bounds(points).select(*[index(F.col(p), r).alias(n) for p, n in zip("xyz", IJK, strict=True)]).distinct()


def counts(points: DataFrame, r: int) -> DataFrame:
    r = resolution(r)
    return in_bounds(points).groupBy(*[index(F.col(p), r).alias(n) for p, n in zip("xyz", IJK, strict=True)]).agg(F.count(F.lit(1)).alias("n"))


def flat_index(r: int) -> Column:
    return (F.col("i").cast("long") * r + F.col("j")) * r + F.col("k")


def grid(spark: SparkSession, r: int) -> DataFrame:
    """All voxels, from one range: no join."""
    r = resolution(r)
    n = F.col("id")
    return spark.range(r**3).select(F.floor(n / (r * r)).cast("int").alias("i"), (F.floor(n / r) % r).cast("int").alias("j"), (n % r).cast("int").alias("k"))


def grid_vertices(spark: SparkSession, r: int) -> DataFrame:
    """The (R + 1)^3 corners of the grid."""
    return grid(spark, resolution(r) + 1).select(*IJK, *[(F.col(a) / F.lit(float(r)) - 0.5).alias(p) for a, p in zip(IJK, "xyz", strict=True)])


def centers(voxels: DataFrame, r: int) -> DataFrame:
    return voxels.select(*IJK, *[((F.col(a) + 0.5) / F.lit(float(r)) - 0.5).alias(p) for a, p in zip(IJK, "xyz", strict=True)])


def query_points(voxels: DataFrame, r: int, *keep: str) -> DataFrame:
    """Centre (number 0) and eight corners of each voxel; corners on the cube's border are exempt from proofs."""
    corners = [(0, 0.5, 0.5, 0.5)] + [(1 + 4 * a + 2 * b + c, float(a), float(b), float(c)) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    offsets = F.array(*[F.struct(F.lit(n).alias("point"), *[F.lit(x).alias(f"d{s}") for s, x in zip(IJK, o, strict=True)]) for n, *o in corners])
    rows = voxels.select(*keep, *IJK, F.explode(offsets).alias("o"))
    border = reduce(lambda a, b: a | b, [(F.col(s) + F.col(f"o.d{s}")).isin(0.0, float(r)) for s in IJK])
    places = [((F.col(s) + F.col(f"o.d{s}")) / F.lit(float(r)) - 0.5).alias(p) for s, p in zip(IJK, "xyz", strict=True)]
    return rows.select(*keep, *IJK, F.col("o.point").alias("point"), *places, ((F.col("o.point") > 0) & border).alias("exempt"))


def boundary_faces(voxels: DataFrame) -> DataFrame:
    """Faces whose neighbour in their direction is not occupied: one anti-join on the neighbour's key."""
    sides = F.array(*[F.struct(F.lit(n).alias("face"), *[F.lit(d).alias(f"d{s}") for s, d in zip(IJK, way, strict=True)]) for n, (way, _) in enumerate(FACES)])
    faces = voxels.select(*IJK, F.explode(sides).alias("o")).select(*IJK, F.col("o.face").alias("face"), *[(F.col(s) + F.col(f"o.d{s}")).alias(f"n{s}") for s in IJK])
    return faces.join(voxels.select(*[F.col(s).alias(f"n{s}") for s in IJK]), [f"n{s}" for s in IJK], "left_anti").select(*IJK, "face")


def boundary_triangles(voxels: DataFrame, r: int) -> DataFrame:
    """Two triangles per exposed face, with the voxel each belongs to; face_id is a key, not a dense number."""
    corners = F.array(*[F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in ring]) for _, ring in FACES])
    faces = boundary_faces(voxels).withColumn("ring", F.element_at(corners, F.col("face") + 1))
    halves = F.array(*[F.struct(F.lit(n).alias("half"), *[F.lit(c).alias(f"c{m}") for m, c in enumerate(t)]) for n, t in enumerate(((0, 1, 2), (0, 2, 3)))])
    rows = faces.withColumn("t", F.explode(halves))
    corner = lambda m, a: ((F.col(IJK[a]) + F.element_at(F.element_at("ring", F.col(f"t.c{m}") + 1), a + 1)) / F.lit(float(r)) - 0.5).alias(f"{'xyz'[a]}{m}")
    return rows.select((flat_index(r) * 12 + F.col("face") * 2 + F.col("t.half")).alias("face_id"), *IJK, *[corner(m, a) for m in range(3) for a in range(3)])


def l1_distance(cells: DataFrame, r: int, mask: str) -> DataFrame:
    """Cells of a full grid with their L1 distance to the nearest cell of the mask, 3R without any: a running minimum in
    both directions along each axis, so three shuffles of whole lines instead of all pairs."""
    far = 3 * r
    out = cells.withColumn("distance", F.when(F.col(mask), 0).otherwise(far))
    for axis in IJK:
        line = Window.partitionBy(*[s for s in IJK if s != axis])
        ahead = F.min(F.col("distance") - F.col(axis)).over(line.orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)) + F.col(axis)
        back = F.min(F.col("distance") + F.col(axis)).over(line.orderBy(F.desc(axis)).rowsBetween(Window.unboundedPreceding, 0)) - F.col(axis)
        out = out.withColumn("distance", F.least(ahead, back, F.lit(far)))
    return out


def labels(spark: SparkSession, r: int, visible: DataFrame, free: DataFrame) -> DataFrame:
    """Label of every voxel: VALID where visible, minus the L1 distance to the nearest voxel that is not free where free, else UNKNOWN."""
    full = grid(spark, r).join(visible.select(*IJK).distinct().withColumn("seen", F.lit(True)), list(IJK), "left").join(free.select(*IJK).distinct().withColumn("empty", F.lit(True)), list(IJK), "left")
    marked = full.select(*IJK, F.coalesce("seen", F.lit(False)).alias("seen"), F.coalesce("empty", F.lit(False)).alias("empty"))
    measured = l1_distance(marked.withColumn("anchor", ~F.col("empty")), r, "anchor")
    return measured.select(*IJK, F.when(F.col("empty"), -F.col("distance")).when(F.col("seen"), VALID).otherwise(UNKNOWN).cast("long").alias("label"))


def overlaps_box(t: list[v.Vec], half: float) -> Column:
    """Whether a triangle, relative to a cube's centre, meets the cube: no axis of thirteen separates them; touching counts."""
    eps = half * 1e-5
    tests = []
    for a in range(3):
        tests += [F.least(*[p[a] for p in t]) <= half + eps, F.greatest(*[p[a] for p in t]) >= -half - eps]
    edges = [v.sub(t[1], t[0]), v.sub(t[2], t[1]), v.sub(t[0], t[2])]
    normal = v.cross(edges[0], edges[1])
    tests.append(F.abs(v.dot(normal, t[0])) <= half * (F.abs(normal[0]) + F.abs(normal[1]) + F.abs(normal[2])) + eps)
    for a in range(3):
        b, c = (a + 1) % 3, (a + 2) % 3
        for e in edges:  # e x unit(a) = (0, ...) with e[c] along b and -e[b] along c
            p = [q[b] * e[c] - q[c] * e[b] for q in t]
            reach = half * (F.abs(e[c]) + F.abs(e[b])) + eps
            tests.append((F.least(*p) <= reach) & (F.greatest(*p) >= -reach))
    return reduce(lambda a, b: a & b, tests)


def voxelize_triangles(triangles: DataFrame, r: int) -> DataFrame:
    """(face_id, i, j, k) of all voxels a triangle meets. Of each triangle's index box the blocks are generated and tested first;
    those that are met are dealt out, and their voxels generated and tested, so a large triangle is many tasks' work and costs
    as its area, not as its box. Triangles without area count by their corners."""
    r = resolution(r)
    half = 0.5 / r
    t = [v.cols(f"x{m}", f"y{m}", f"z{m}") for m in range(3)]
    flat = v.norm(v.cross(v.sub(t[1], t[0]), v.sub(t[2], t[0]))) <= 0
    lows = [F.least(*[p[a] for p in t]) for a in range(3)]
    highs = [F.greatest(*[p[a] for p in t]) for a in range(3)]
    near = reduce(lambda a, b: a & b, [(lo <= 0.5) & (hi >= -0.5) for lo, hi in zip(lows, highs, strict=True)])
    pad = half * 1e-4
    rows = triangles.where(near & ~flat).select("face_id", *[f"{a}{m}" for m in range(3) for a in "xyz"])
    rows = rows.withColumns({f"{e}{s}": index(x, r) for a, s in enumerate(IJK) for e, x in (("lo_", lows[a] - pad), ("hi_", highs[a] + pad))})
    for s in IJK:
        rows = rows.withColumn(f"b{s}", F.explode(F.sequence(F.floor(F.col(f"lo_{s}") / BLOCK), F.floor(F.col(f"hi_{s}") / BLOCK))))
    middle = tuple((F.col(f"b{s}") + 0.5) * (BLOCK / r) - 0.5 for s in IJK)
    rows = rows.where(overlaps_box([v.sub(p, middle) for p in t], half * BLOCK))
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bi", "bj", "bk", "face_id")
    for s in IJK:
        first = F.greatest(F.col(f"lo_{s}"), (F.col(f"b{s}") * BLOCK).cast("int"))
        rows = rows.withColumn(s, F.explode(F.sequence(first, F.least(F.col(f"hi_{s}"), (F.col(f"b{s}") * BLOCK + (BLOCK - 1)).cast("int")))))
    centre = tuple((F.col(s) + 0.5) / F.lit(float(r)) - 0.5 for s in IJK)
    met = rows.where(overlaps_box([v.sub(p, centre) for p in t], half)).select("face_id", *IJK)
    corners = F.array(*[F.struct(*[p[a].alias("xyz"[a]) for a in range(3)]) for p in t])
    points = triangles.where(flat).select("face_id", F.explode(corners).alias("p")).select("face_id", "p.*")
    return met.unionByName(in_bounds(points).select("face_id", *[index(F.col(p), r).alias(s) for p, s in zip("xyz", IJK, strict=True)]).distinct())
