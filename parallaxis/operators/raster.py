"""Triangle rasterisation as joins and aggregates: fragments by generated pixels, a z-buffer by the least (depth, face),
attributes by the fragments' weights of their face's corners."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import camera as c
from ..functions import vector as v
from . import small

#: Side of the pixel tiles that boxes are cut into before their pixels are generated.
TILE = 32
CORNERS = [f"{a}{m}" for m in range(3) for a in "xyz"]


def _parts(near: float) -> Column:
    """The parts of a triangle before the near plane, as corners with their place in the camera's frame (px, py, pz; pz is
    the distance before its plane) and weights (w0, w1, w2) of the triangle's own corners. Corners stand in order, so a
    corner that is alone on its side is brought to the front by turning them."""
    corner = [F.struct(*[F.col(f"p{a}{m}").alias(f"p{a}") for a in "xyz"], *[F.lit(float(m == k)).alias(f"w{k}") for k in range(3)]) for m in range(3)]
    front = [F.col(f"pz{m}") > near for m in range(3)]
    ahead = reduce(lambda a, b: a + b, [f.cast("int") for f in front])

    def cut(a: Column, b: Column) -> Column:
        t = (near - a["pz"]) / (b["pz"] - a["pz"])
        return F.struct(*[(F.lit(float(near)) if n == "pz" else a[n] + t * (b[n] - a[n])).alias(n) for n in ("px", "py", "pz", "w0", "w1", "w2")])

    def turned(k: int) -> tuple[Column, Column, Column]:
        return corner[k], corner[(k + 1) % 3], corner[(k + 2) % 3]

    def one_ahead(k: int) -> Column:
        a, b, d = turned(k)
        return F.array(F.array(a, cut(a, b), cut(a, d)))

    def one_behind(k: int) -> Column:
        d, a, b = turned(k)
        return F.array(F.array(a, b, cut(b, d)), F.array(a, cut(b, d), cut(a, d)))

    alone = lambda f, make: F.when(f[0], make(0)).when(f[1], make(1)).otherwise(make(2))
    return F.when(ahead == 3, F.array(F.array(*corner))).when(ahead == 1, alone(front, one_ahead)).when(ahead == 2, alone([~f for f in front], one_behind))


def fragments(triangles: DataFrame, cameras: DataFrame, near: float = c.FRONT) -> DataFrame:
    """(cam_idx, row, col, face_id, depth, b1, b2) of all pixel centres that a triangle covers beyond the near plane, which
    cuts triangles that cross it. Depth and the weights b1 and b2 of the face's second and third corner are interpolated with
    perspective. Boxes are dealt out by tiles, so a triangle that fills the image is many tasks' work."""
    rows = triangles.select("face_id", *CORNERS).join(small(cameras.select("cam_idx", "width", "height", "fovx_deg", "fovy_deg", "cx", "cy", "w2c")))
    m = v.matrix("w2c")
    for k in range(3):
        x, y, z = v.apply(m, v.cols(f"x{k}", f"y{k}", f"z{k}"))
        rows = rows.withColumns({f"px{k}": x, f"py{k}": y, f"pz{k}": -z})
    rows = rows.select("cam_idx", "width", "height", c.fx().alias("fx"), c.fy().alias("fy"), "cx", "cy", "face_id", F.explode(_parts(near)).alias("part"))
    for k in range(3):
        p = F.col("part")[k]
        rows = rows.withColumns({f"px{k}": F.col("fx") * p["px"] / p["pz"] + F.col("cx"), f"py{k}": F.col("height") - (F.col("fy") * p["py"] / p["pz"] + F.col("cy")), f"pz{k}": p["pz"], **{f"w{n}{k}": p[f"w{n}"] for n in (1, 2)}})
    lo, hi = (lambda n: F.least(*[F.col(f"{n}{k}") for k in range(3)])), (lambda n: F.greatest(*[F.col(f"{n}{k}") for k in range(3)]))
    # pixel centres are half a pixel in: the first at or after the box's start, the last at or before its end
    first = lambda n: F.ceil(F.greatest(F.lit(0.0), lo(n) - 0.5))
    last = lambda n, size: F.floor(F.least(F.col(size) - 1.0, hi(n) - 0.5))
    rows = rows.withColumns({"c0": first("px"), "c1": last("px", "width"), "r0": first("py"), "r1": last("py", "height")}).where("c0 <= c1 and r0 <= r1").drop("part", "fx", "fy", "cx", "cy", "width", "height")
    tiles = lambda a, b: F.sequence(F.floor(F.col(a) / TILE), F.floor(F.col(b) / TILE))
    rows = rows.withColumn("tr", F.explode(tiles("r0", "r1"))).withColumn("tc", F.explode(tiles("c0", "c1")))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "cam_idx", "tr", "tc", "face_id")
    span = lambda a, b, t: F.sequence(F.greatest(F.col(a), F.col(t) * TILE), F.least(F.col(b), F.col(t) * TILE + (TILE - 1)))
    rows = rows.withColumn("row", F.explode(span("r0", "r1", "tr"))).withColumn("col", F.explode(span("c0", "c1", "tc")))
    x, y = F.col("col") + 0.5, F.col("row") + 0.5

    def edge(a: int, b: int) -> Column:
        return (F.col(f"px{b}") - F.col(f"px{a}")) * (y - F.col(f"py{a}")) - (F.col(f"py{b}") - F.col(f"py{a}")) * (x - F.col(f"px{a}"))

    rows = rows.withColumns({"e0": edge(1, 2), "e1": edge(2, 0), "e2": edge(0, 1)}).withColumn("area", F.col("e0") + F.col("e1") + F.col("e2"))
    rows = rows.where("area <> 0 and e0 * area >= 0 and e1 * area >= 0 and e2 * area >= 0")
    over = lambda n: (F.col("e0") * n(0) / F.col("pz0") + F.col("e1") * n(1) / F.col("pz1") + F.col("e2") * n(2) / F.col("pz2")) / F.col("area")
    depth = 1 / over(lambda k: F.lit(1.0))
    weight = lambda n: (over(lambda k: F.col(f"w{n}{k}")) * depth).alias(f"b{n}")
    return rows.select("cam_idx", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "face_id", depth.alias("depth"), weight(1), weight(2))


def z_buffer(frags: DataFrame) -> DataFrame:
    """The nearest fragment of each pixel, of equals the one with the smallest face: partial minima before the shuffle."""
    return frags.groupBy("cam_idx", "row", "col").agg(F.min(F.struct("depth", "face_id", "b1", "b2")).alias("n")).select("cam_idx", "row", "col", *[f"n.{x}" for x in ("face_id", "depth", "b1", "b2")])


def render_mask(seen: DataFrame, cameras: DataFrame) -> DataFrame:
    """(cam_idx, row, col, mask) of every pixel of every camera: whether it shows a face."""
    return frame(cameras).join(seen.select("cam_idx", "row", "col", F.lit(True).alias("mask")), ["cam_idx", "row", "col"], "left").withColumn("mask", F.coalesce("mask", F.lit(False)))


def frame(cameras: DataFrame) -> DataFrame:
    """(cam_idx, row, col) of every pixel of every camera."""
    rows = cameras.select("cam_idx", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("row"), "width")
    return rows.select("cam_idx", "row", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("col"))


def render_depth(seen: DataFrame, cameras: DataFrame) -> DataFrame:
    """Depth of every pixel, 0 where nothing is seen."""
    return frame(cameras).join(seen.select("cam_idx", "row", "col", "depth"), ["cam_idx", "row", "col"], "left").withColumn("depth", F.coalesce("depth", F.lit(0.0)))


def render_normals(seen: DataFrame, triangles: DataFrame, cameras: DataFrame) -> DataFrame:
    """Each seen pixel with its face's normal in the world (nx, ny, nz) and in the camera's frame (mx, my, mz)."""
    rows = seen.join(face_normals(triangles), "face_id").join(small(cameras.select("cam_idx", "w2c")), "cam_idx")
    turned = v.apply(v.matrix("w2c"), v.cols("nx", "ny", "nz"), translate=False)
    return rows.select("cam_idx", "row", "col", "face_id", "nx", "ny", "nz", *[x.alias(f"m{a}") for x, a in zip(turned, "xyz", strict=True)])


def interpolate(seen: DataFrame, faces: DataFrame, attributes: DataFrame, names: list[str]) -> DataFrame:
    """Seen pixels with values of their faces' corners, interpolated. faces: (face_id, v0, v1, v2); attributes: (vid, names)."""
    rows = seen.join(faces.select("face_id", "v0", "v1", "v2"), "face_id")
    for k in range(3):
        rows = rows.join(attributes.select(F.col("vid").alias(f"v{k}"), *[F.col(n).alias(f"_{n}{k}") for n in names]), f"v{k}")
    first = 1 - F.col("b1") - F.col("b2")
    mixed = [(first * F.col(f"_{n}0") + F.col("b1") * F.col(f"_{n}1") + F.col("b2") * F.col(f"_{n}2")).alias(n) for n in names]
    return rows.select(*seen.columns, *mixed)


def sample_bilinear(rows: DataFrame, texture: DataFrame, width: int, height: int, names: list[str], mode: str | tuple[str, str] = "clamp", u: str = "tu", w: str = "tv") -> DataFrame:
    """Rows with the texture's values at (u, w), w upwards, mixed of the four texels around the place; beyond the border the
    wrap mode, one for both axes or one each, gives the texel. texture: (row, col, names), row 0 at the top; four joins on the
    texel's place."""
    across, down = (mode, mode) if isinstance(mode, str) else mode
    x, y = wrap(F.col(u), across) * width - 0.5, (1 - wrap(F.col(w), down)) * height - 0.5
    rows = rows.withColumns({"_x": F.floor(x), "_y": F.floor(y), "_fx": x - F.floor(x), "_fy": y - F.floor(y)})
    at = lambda p, size, mode: F.pmod(p, F.lit(size)) if mode == "repeat" else F.greatest(F.lit(0), F.least(F.lit(size - 1), p))
    columns = [n for n in rows.columns if not n.startswith("_")]
    texels = small(texture.select("row", "col", *names))
    total: dict[str, Column] = {}
    for k, (dx, dy) in enumerate(((0, 0), (1, 0), (0, 1), (1, 1))):
        near = texels.select(F.col("row").cast("long").alias(f"_at_row{k}"), F.col("col").cast("long").alias(f"_at_col{k}"), *[F.col(n).alias(f"_value_{n}{k}") for n in names])
        rows = rows.withColumns({f"_at_row{k}": at(F.col("_y") + dy, height, down), f"_at_col{k}": at(F.col("_x") + dx, width, across)}).join(near, [f"_at_row{k}", f"_at_col{k}"])
        share = (F.col("_fx") if dx else 1 - F.col("_fx")) * (F.col("_fy") if dy else 1 - F.col("_fy"))
        for n in names:
            total[n] = total[n] + share * F.col(f"_value_{n}{k}") if n in total else share * F.col(f"_value_{n}{k}")
    return rows.select(*columns, *[e.alias(n) for n, e in total.items()])


def matcap_place(normal: v.Vec) -> tuple[Column, Column]:
    """Texture place of a normal in the camera's frame: its x and y from -1..1 to 0..1."""
    return normal[0] * 0.5 + 0.5, normal[1] * 0.5 + 0.5


def on_background(seen: DataFrame, cameras: DataFrame, values: dict[str, float]) -> DataFrame:
    """Every pixel of every camera with the seen pixels' values, elsewhere the background's."""
    rows = frame(cameras).join(seen.select("cam_idx", "row", "col", *values), ["cam_idx", "row", "col"], "left")
    return rows.select("cam_idx", "row", "col", *[F.coalesce(n, F.lit(float(x))).alias(n) for n, x in values.items()])


def shows_any(seen: DataFrame, cameras: DataFrame) -> DataFrame:
    """(cam_idx, any): whether a camera sees a face at all."""
    some = seen.select("cam_idx").distinct().withColumn("any", F.lit(True))
    return cameras.select("cam_idx").join(some, "cam_idx", "left").withColumn("any", F.coalesce("any", F.lit(False)))


def face_normals(triangles: DataFrame) -> DataFrame:
    t = [v.cols(f"x{m}", f"y{m}", f"z{m}") for m in range(3)]
    n = v.unit(v.cross(v.sub(t[1], t[0]), v.sub(t[2], t[0])))
    return triangles.select("face_id", *[x.alias(f"n{a}") for x, a in zip(n, "xyz", strict=True)])


def shade(normal: v.Vec, lights: list[tuple[tuple[float, float, float], float]], ambient: float) -> Column:
    """Ambient light and the lights' cosines, at most 1."""
    total = F.lit(float(ambient))
    for direction, strength in lights:
        total = total + float(strength) * F.greatest(F.lit(0.0), v.dot(normal, v.unit(v.lit3(*direction))))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def wrap(at: Column, mode: str) -> Column:
    """Texture coordinate under a wrap mode: repeat, mirror or clamp."""
    if mode == "repeat":
        return F.pmod(at, F.lit(1.0))
    if mode == "mirror":
        return 1 - F.abs(F.pmod(at, F.lit(2.0)) - 1)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), at))
