"""Pinhole cameras as column expressions.

A camera row has cam_idx, width, height, fovx_deg, fovy_deg (null: as the aspect gives it), cx, cy and w2c, a row-major
4x4 world-to-camera matrix. Cameras look along -z with y up; u grows to the right and v upwards from the lower left
corner, and the optical axis meets the image half a pixel beyond (cx, cy).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vector as v

#: Points nearer to the camera's plane than this are behind it.
FRONT = 1e-6


def fx() -> Column:
    return F.col("width") / (2 * F.tan(F.radians(F.col("fovx_deg")) / 2))


def fovy_deg() -> Column:
    same = F.degrees(2 * F.atan(F.tan(F.radians(F.col("fovx_deg")) / 2) * F.col("height") / F.col("width")))
    return F.coalesce(F.col("fovy_deg"), same)


def fy() -> Column:
    return F.when(F.col("fovy_deg").isNull(), fx()).otherwise(F.col("height") / (2 * F.tan(F.radians(F.col("fovy_deg")) / 2)))


def fovx_of(focal: Column, width: Column) -> Column:
    return F.degrees(2 * F.atan(width / (2 * focal)))


def with_fov(df: DataFrame, degrees: Column) -> DataFrame:
    """The field of view replaced; one that is not between 0 and 180 degrees ends the query."""
    good = (degrees > 0) & (degrees < 180)
    return df.withColumn("fovx_deg", F.when(good, degrees).otherwise(F.raise_error(F.concat(F.lit("field of view must be in (0, 180), not "), F.coalesce(degrees.cast("string"), F.lit("null")))).cast("double")))


def with_intrinsics(df: DataFrame, fx_: Column, cx: Column, cy: Column, width: Column | None = None, height: Column | None = None, fy_: Column | None = None) -> DataFrame:
    """Focal lengths in pixels, principal point and size replaced. A vertical field of view of its own is kept only where the two
    focal lengths differ."""
    rows = df.withColumns({"width": (F.col("width") if width is None else width).cast("int"), "height": (F.col("height") if height is None else height).cast("int"), "_fx": fx_, "_fy": fx_ if fy_ is None else fy_})
    own = F.when(F.abs(F.col("_fy") - F.col("_fx")) > 1e-9, fovx_of(F.col("_fy"), F.col("height")))
    return rows.withColumns({"fovx_deg": fovx_of(F.col("_fx"), F.col("width")), "fovy_deg": own, "cx": cx.cast("double"), "cy": cy.cast("double")}).drop("_fx", "_fy")


def with_size(df: DataFrame, width: int, height: int) -> DataFrame:
    """Another image size, the principal point in its middle; fields of view stay."""
    return df.withColumns({"width": F.lit(width), "height": F.lit(height), "cx": F.lit(width / 2), "cy": F.lit(height / 2)})


def intrinsic_matrix() -> Column:
    zero = F.lit(0.0)
    return v.flat([[fx(), zero, F.col("cx").cast("double")], [zero, fy(), F.col("cy").cast("double")], [zero, zero, F.lit(1.0)]])


def from_matrices(df: DataFrame, extrinsic: str, intrinsic: str, signs: tuple[int, ...]) -> DataFrame:
    """Camera columns of rows with a 4x4 extrinsic in another convention (see flip) and a 3x3 intrinsic matrix, both row-major;
    the image's size is twice the principal point."""
    k = v.matrix(intrinsic, 3)
    rows = df.withColumns({"width": (2 * k[0][2]).cast("int"), "height": (2 * k[1][2]).cast("int"), "w2c": flip(extrinsic, signs)})
    return with_intrinsics(rows, k[0][0], k[0][2], k[1][2], fy_=k[1][1])


def from_quaternion(df: DataFrame, intrinsic: str) -> DataFrame:
    """Camera columns of rows with qw, qx, qy, qz, tx, ty, tz in the convention of pose folders and an intrinsic matrix."""
    r = rotation_of(v.cols("qw", "qx", "qy", "qz"))
    last = [F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    rows = df.withColumn("_pose", v.flat([[*row, t] for row, t in zip(r, v.cols("tx", "ty", "tz"), strict=True)] + [last]))
    return from_matrices(rows, "_pose", intrinsic, CAMERA_FRAME).drop("_pose")


def rotation(w2c: str = "w2c") -> list[v.Vec]:
    return [tuple(row[:3]) for row in v.matrix(w2c)[:3]]


def translation(w2c: str = "w2c") -> v.Vec:
    return tuple(row[3] for row in v.matrix(w2c)[:3])


def position(w2c: str = "w2c") -> v.Vec:
    """The camera's centre, -R't."""
    r, t = rotation(w2c), translation(w2c)
    return tuple(-v.dot(tuple(r[i][j] for i in range(3)), t) for j in range(3))


def forward(w2c: str = "w2c") -> v.Vec:
    return tuple(-x for x in rotation(w2c)[2])


def up(w2c: str = "w2c") -> v.Vec:
    return rotation(w2c)[1]


def pose(x: v.Vec, y: v.Vec, z: v.Vec, centre: v.Vec) -> Column:
    """w2c of a camera with these world axes at this place."""
    last = [F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    return v.flat([[*a, -v.dot(a, centre)] for a in (x, y, z)] + [last])


def polar_pose(phi: Column, theta: Column, dist: Column, target: v.Vec) -> Column:
    """The pose that looks at the target from (phi, theta) on a sphere around it; valid at the poles too."""
    sp, cp, st, ct = F.sin(phi), F.cos(phi), F.sin(theta), F.cos(theta)
    z = (sp * st, sp * ct, cp)
    return pose((-ct, st, F.lit(0.0)), (-cp * st, -cp * ct, sp), z, v.add(target, v.scale(z, dist)))


def look_at(df: DataFrame, centre: v.Vec, target: v.Vec, upward: v.Vec, name: str = "w2c") -> DataFrame:
    """Adds the pose from a place, a target and an up vector; parallel to the view, up falls back to y, then to x. Each axis
    is a column of its own before the next is made of it, so expressions do not multiply."""
    axis = lambda n: v.cols(*[f"_{n}{a}" for a in "xyz"])
    keep = lambda n, t: {f"_{n}{a}": x for a, x in zip("xyz", t, strict=True)}
    rows = df.withColumns(keep("c", centre) | keep("d", v.sub(target, centre)) | keep("u", v.unit(upward, 1e-8)))
    rows = rows.withColumns(keep("f", v.unit(axis("d"), 1e-8)))
    rows = rows.withColumns(keep("p", v.cross(axis("f"), axis("u"))) | keep("q", v.cross(axis("f"), v.lit3(0, 1, 0))) | keep("r", v.cross(axis("f"), v.lit3(1, 0, 0))))
    side = tuple(F.when(v.norm(axis("p")) >= 1e-6, a).when(v.norm(axis("q")) >= 1e-6, b).otherwise(c) for a, b, c in zip(axis("p"), axis("q"), axis("r"), strict=True))
    rows = rows.withColumns(keep("s", side))
    rows = rows.withColumns(keep("x", v.unit(axis("s"), 1e-8)) | keep("z", tuple(-a for a in axis("f"))))
    rows = rows.withColumns(keep("t", v.cross(axis("z"), axis("x"))))
    rows = rows.withColumns(keep("y", v.unit(axis("t"), 1e-8)))
    return rows.withColumn(name, pose(axis("x"), axis("y"), axis("z"), axis("c"))).drop(*[f"_{n}{a}" for n in "cdufpqrsxzty" for a in "xyz"])


def inverse_pose(w2c: str = "w2c") -> Column:
    """Camera-to-world of a rigid world-to-camera matrix."""
    r, p = rotation(w2c), position(w2c)
    last = [F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    return v.flat([[r[0][j], r[1][j], r[2][j], p[j]] for j in range(3)] + [last])


#: Signs that turn a pose into the convention with y down and z ahead: in both frames, or in the camera's alone.
BOTH_FRAMES = (1, -1, -1, 1, -1, 1, 1, -1, -1, 1, 1, -1, 1, -1, -1, 1)
CAMERA_FRAME = (1, 1, 1, 1, -1, -1, -1, -1, -1, -1, -1, -1, 1, 1, 1, 1)


def flip(w2c: str, signs: tuple[int, ...]) -> Column:
    return F.zip_with(F.col(w2c), F.array(*[F.lit(float(s)) for s in signs]), lambda a, s: a * s)


def quaternion(rows: list[v.Vec]) -> tuple[Column, Column, Column, Column]:
    """(w, x, y, z) with w >= 0 of a rotation, from the largest of its four squared components."""
    (a, b, c), (d, e, f), (g, h, i) = rows
    t = [a + e + i, a - e - i, -a + e - i, -a - e + i]
    top = F.greatest(*t)
    s = F.sqrt(top + 1) * 2
    cases = [
        (s / 4, (h - f) / s, (c - g) / s, (d - b) / s),
        ((h - f) / s, s / 4, (b + d) / s, (c + g) / s),
        ((c - g) / s, (b + d) / s, s / 4, (f + h) / s),
        ((d - b) / s, (c + g) / s, (f + h) / s, s / 4),
    ]
    q = [F.when(t[0] == top, cases[0][k]).when(t[1] == top, cases[1][k]).when(t[2] == top, cases[2][k]).otherwise(cases[3][k]) for k in range(4)]
    sign = F.when(q[0] < 0, -1.0).otherwise(1.0)
    return tuple(x * sign for x in q)


def rotation_of(q: tuple[Column, Column, Column, Column]) -> list[v.Vec]:
    w, x, y, z = q
    return [
        (1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)),
        (2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)),
        (2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)),
    ]


def polar() -> tuple[Column, Column]:
    """(phi, theta) of the direction against the camera's view; theta is 0 at the poles, where every azimuth fits."""
    z = rotation()[2]
    at_pole = z[0] * z[0] + z[1] * z[1] < 1e-24
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z[2]))), F.when(at_pole, 0.0).otherwise(F.atan2(z[0], z[1]))


def clip_matrix(near: float = 0.01, far: float = 100.0) -> Column:
    """World to clip space with y downwards, row-major."""
    w, h = F.col("width"), F.col("height")
    zero = F.lit(0.0)
    proj = [
        [2 * fx() / w, zero, 1 - 2 * F.col("cx") / w, zero],
        [zero, -(2 * fy() / h), -(1 - 2 * F.col("cy") / h), zero],
        [zero, zero, F.lit((far + near) / (near - far)), F.lit(2 * far * near / (near - far))],
        [zero, zero, F.lit(-1.0), zero],
    ]
    m = v.matrix("w2c")
    return v.flat([[v.dot(tuple(row), tuple(m[k][j] for k in range(4))) for j in range(4)] for row in proj])


def project(df: DataFrame, point: v.Vec) -> DataFrame:
    """Adds u, v (null behind the camera) and depth, the distance before the camera's plane."""
    x, y, z = v.apply(v.matrix("w2c"), point)
    seen = z < -FRONT
    u = F.when(seen, (fx() * x / F.nullif(-z, F.lit(0.0)) + F.col("cx") + 0.5) / F.col("width"))
    w = F.when(seen, (fy() * y / F.nullif(-z, F.lit(0.0)) + F.col("cy") + 0.5) / F.col("height"))
    return df.withColumns({"u": u, "v": w, "depth": -z})


def back_project(u: Column, w: Column, depth: Column) -> v.Vec:
    """World point seen at (u, v) in that depth."""
    x = (u * F.col("width") - 0.5 - F.col("cx")) * depth / fx()
    y = (w * F.col("height") - 0.5 - F.col("cy")) * depth / fy()
    r = rotation()
    d = v.sub((x, y, -depth), translation())
    return tuple(v.dot(tuple(r[i][j] for i in range(3)), d) for j in range(3))


def nearest_pixel(at: Column, size: Column) -> Column:
    """Row or column whose centre is nearest, halves to the even one, clamped."""
    return F.greatest(F.lit(0), F.least(size - 1, F.bround(at * size - 0.5).cast("int")))


def covering_pixel(at: Column, size: Column) -> Column:
    """Row or column that covers the place, clamped."""
    return F.greatest(F.lit(0), F.least(size - 1, (at * size).cast("int")))
