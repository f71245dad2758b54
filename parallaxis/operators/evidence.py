"""Proofs that voxels are empty, found in blocks.

What a camera shows is laid out as a pyramid: for squares of 1, 2, 4... pixels the least and the greatest distance shown in
them. The cube is cut into blocks of voxels. A block whose projection lies inside a camera's frame and wholly before the least
distance shown there is empty; one that lies outside the frame, or behind the greatest distance, tells nothing in that camera.
Only blocks that are neither are halved along each axis and looked at again, and none that some camera has proved. So the work
follows the surfaces and silhouettes, not the volume times the cameras. Of single voxels that the bounds leave open the nine points
are tested in turns, the centre first, the others of those voxels alone that passed.

All bounds are widened by more than rounding can err, so what they decide, the exact proof would decide alike. The loop has
one turn a halving: the logarithm of the resolution.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import camera as c
from ..functions import vector as v
from ..storage import kept
from . import small
from .voxels import IJK, query_points, resolution

#: By how much bounds of places in the image, and of distances relative to themselves, are widened.
SLACK = 1e-9
#: Squares of a level, along each side, that one row of the pyramid tells of.
SQUARES = 3
#: Halvings of the cube's side before blocks are first looked at: 64 blocks.
FIRST_HALVINGS = 2
#: Points of a voxel (0 is the centre) that are tested together.
TURNS = ((0,), (1, 8), (2, 3, 4, 5, 6, 7))
CAMERA = ("cam_idx", "width", "height", "fovx_deg", "fovy_deg", "cx", "cy", "w2c")


def pyramid(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """(cam_idx, level, a, b, low, high, whole): least and greatest `end` in the SQUARES by SQUARES squares of 2**level pixels from
    square (a, b) on, and whether every pixel of the frame there has one. So a rectangle of any place and size is covered by one
    row, rather closely. pixels: (cam_idx, row, col, end); sizes: (cam_idx, width, height)."""
    framed = pixels.join(small(sizes), "cam_idx")
    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest("width", "height"))).cast("int") + 1)
    rows = framed.withColumn("level", F.explode(levels))
    square = lambda n: F.expr(f"shiftright({n}, level)")
    ones = rows.groupBy("cam_idx", "width", "height", "level", square("row").alias("a"), square("col").alias("b")).agg(F.min("end").alias("low"), F.max("end").alias("high"), F.count("end").alias("n"))
    steps = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in range(SQUARES) for y in range(SQUARES)])
    spread = ones.withColumn("s", F.explode(steps)).withColumns({"a": F.col("a") - F.col("s.x"), "b": F.col("b") - F.col("s.y")})
    sums = spread.groupBy("cam_idx", "width", "height", "level", "a", "b").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    side = lambda n, size: F.least(F.expr(f"shiftleft({n} + {SQUARES}, level)"), F.col(size)) - F.greatest(F.expr(f"shiftleft({n}, level)"), F.lit(0))
    return sums.where("a >= 0 and b >= 0").select("cam_idx", "level", "a", "b", "low", "high", (F.col("n") == side("a", "height") * side("b", "width")).alias("whole"))


def blocks(rows: DataFrame, size: int, r: int) -> DataFrame:
    """Adds to (cam_idx, i, j, k: numbers of blocks of this size; the camera) what a camera makes of a block: near and far, its
    distances before the camera's plane, and u0, u1, w0, w1, the bounds of its image, from the left and from the top."""
    low = {s: F.col(s) * (size / r) - 0.5 for s in IJK}
    wide = {s: (F.least((F.col(s) + 1) * size, F.lit(r)) - F.col(s) * size) / F.lit(float(r)) for s in IJK}
    base = v.apply(v.matrix("w2c"), tuple(low[s] for s in IJK))
    turn = c.rotation()
    out = rows.withColumns({f"o{n}": x for n, x in zip("xyz", base, strict=True)} | {f"d{n}{s}": turn[m][q] * wide[s] for m, n in enumerate("xyz") for q, s in enumerate(IJK)} | {"f_x": c.fx(), "f_y": c.fy()})
    corner = lambda n, bits: reduce(lambda a, s: a + F.col(f"d{n}{s[1]}") if s[0] else a, zip(bits, IJK, strict=True), F.col(f"o{n}"))
    every = [(a, b, d) for a in (0, 1) for b in (0, 1) for d in (0, 1)]
    out = out.withColumns({f"z{m}": -corner("z", bits) for m, bits in enumerate(every)})
    out = out.withColumns({f"u{m}": (F.col("f_x") * corner("x", bits) / F.nullif(F.col(f"z{m}"), F.lit(0.0)) + F.col("cx") + 0.5) / F.col("width") for m, bits in enumerate(every)} | {f"w{m}": 1 - (F.col("f_y") * corner("y", bits) / F.nullif(F.col(f"z{m}"), F.lit(0.0)) + F.col("cy") + 0.5) / F.col("height") for m, bits in enumerate(every)})
    ends = {}
    for n, (lo, hi) in {"z": ("near", "far"), "u": ("left", "right"), "w": ("top", "bottom")}.items():
        ends |= {lo: F.least(*[F.col(f"{n}{m}") for m in range(8)]), hi: F.greatest(*[F.col(f"{n}{m}") for m in range(8)])}
    pad = SLACK * (1 + F.abs("far"))
    return out.select(*rows.columns, *[x.alias(n) for n, x in ends.items()]).withColumns({"near": F.col("near") - pad, "far": F.col("far") + pad, **{n: F.col(n) - SLACK for n in ("left", "top")}, **{n: F.col(n) + SLACK for n in ("right", "bottom")}})


def looked_up(rows: DataFrame, table: DataFrame, rows_at, cols_at, name: str) -> DataFrame:
    """Adds name: the pyramid's row for the block's rectangle. rows_at, cols_at: pixel of a place from the top, from the left."""
    low, high = F.greatest(F.lit(0.0), F.col("top")), F.least(F.lit(1.0), F.col("bottom"))
    left, right = F.greatest(F.lit(0.0), F.col("left")), F.least(F.lit(1.0), F.col("right"))
    out = rows.withColumns({"_r": rows_at(low), "_c": cols_at(left), "_r1": rows_at(high), "_c1": cols_at(right)})
    # the least level on which the rectangle ends within so many squares from its first, one of these two
    out = out.withColumn("_least", F.greatest(F.lit(0), F.ceil(F.log2((F.greatest(F.col("_r1") - F.col("_r"), F.col("_c1") - F.col("_c")) + 1) / F.lit(float(SQUARES)))).cast("int")))
    fits = reduce(lambda a, b: a & b, [F.expr(f"shiftright(_{n}1, _least) - shiftright(_{n}, _least) < {SQUARES}") for n in "rc"])
    out = out.withColumn("_level", F.when(F.col("met"), F.when(fits, F.col("_least")).otherwise(F.col("_least") + 1)))
    out = out.withColumns({"_a": F.expr("shiftright(_r, _level)"), "_b": F.expr("shiftright(_c, _level)")})
    right_side = table.select(F.col("cam_idx").alias("_cam"), F.col("level").alias("_l"), F.col("a").alias("_x"), F.col("b").alias("_y"), F.struct("low", "high", "whole").alias(name))
    on = (F.col("cam_idx") == F.col("_cam")) & (F.col("_level") == F.col("_l")) & (F.col("_a") == F.col("_x")) & (F.col("_b") == F.col("_y"))
    return out.join(right_side, on, "left").drop("_r", "_c", "_r1", "_c1", "_least", "_level", "_a", "_b", "_cam", "_l", "_x", "_y")


def verdicts(rows: DataFrame, depths: DataFrame, masks: DataFrame | None, size: tuple[int, int]) -> DataFrame:
    """Adds proved and open to the blocks of `blocks`: all of the block is proved empty by the camera, or some of it may be."""
    ahead, inside = F.col("near") > c.FRONT, (F.col("left") >= 0) & (F.col("right") <= 1) & (F.col("top") >= 0) & (F.col("bottom") <= 1)
    outside = (F.col("right") < 0) | (F.col("left") > 1) | (F.col("bottom") < 0) | (F.col("top") > 1)
    rows = rows.withColumn("met", ahead & ~outside)
    out = looked_up(rows, depths, lambda x: c.covering_pixel(x, F.col("height")), lambda x: c.covering_pixel(x, F.col("width")), "shown")
    before = F.coalesce(F.col("shown.whole") & (F.col("far") + F.greatest(F.col("far") * 1e-4, F.lit(1e-6)) < F.col("shown.low")), F.lit(False))
    behind = F.coalesce(F.col("near") >= F.col("shown.high"), F.lit(True))
    if masks is not None:
        width, height = size
        out = looked_up(out, masks, lambda x: c.nearest_pixel(x, F.lit(height)), lambda x: c.nearest_pixel(x, F.lit(width)), "on")
        none_on = F.coalesce(F.col("has_mask"), F.lit(False)) & F.col("on").isNull()
        all_on = ~F.coalesce(F.col("has_mask"), F.lit(False)) | F.coalesce(F.col("on.whole"), F.lit(False))
        before, behind = before | none_on, behind & all_on
    proved = F.col("met") & inside & before
    nothing = (F.col("far") <= c.FRONT) | (ahead & (outside | behind))
    return out.withColumns({"proved": F.coalesce(proved, F.lit(False)), "open": ~F.coalesce(proved, F.lit(False)) & ~F.coalesce(nothing, F.lit(False))})


def tested(points: DataFrame, cameras: DataFrame, depth: DataFrame, masks: DataFrame | None, size: tuple[int, int]) -> DataFrame:
    """points of pairs of camera and voxel, with ok: exempt, or in the camera's frame, strictly before the surface the pixel
    shows, or where its mask says that it sees nothing."""
    seen = c.project(points.join(small(cameras.select(*CAMERA)), "cam_idx"), v.cols("x", "y", "z")).withColumn("framed", F.coalesce(F.col("u").between(0, 1) & F.col("v").between(0, 1), F.lit(False)))
    placed = seen.withColumns({"col": F.when(F.col("framed"), c.covering_pixel(F.col("u"), F.col("width"))), "row": F.when(F.col("framed"), c.covering_pixel(1 - F.col("v"), F.col("height")))})
    met = placed.join(depth.select("cam_idx", "row", "col", F.col("depth").alias("end")), ["cam_idx", "row", "col"], "left")
    if masks is not None:
        width, height = size
        met = met.withColumns({"mc": c.nearest_pixel(F.col("u"), F.lit(width)), "mr": c.nearest_pixel(1 - F.col("v"), F.lit(height))})
        met = met.join(masks.select("cam_idx", F.col("row").alias("mr"), F.col("col").alias("mc"), F.col("mask").alias("on")), ["cam_idx", "mr", "mc"], "left").join(small(masks.select("cam_idx", F.lit(True).alias("has")).distinct()), "cam_idx", "left")
        met = met.withColumn("end", F.when(F.col("framed") & F.col("has") & ~F.coalesce("on", F.lit(False)), float("inf")).otherwise(F.col("end")))
    ok = F.col("exempt") | (F.col("framed") & F.coalesce(F.col("depth") < F.col("end") - F.greatest(F.abs("depth") * 1e-4, F.lit(1e-6)), F.lit(False)))
    return met.select("cam_idx", *IJK, ok.alias("ok"))


def passing(pairs: DataFrame, cameras: DataFrame, depth: DataFrame, r: int, masks: DataFrame | None, size: tuple[int, int], points: tuple[int, ...] = tuple(range(9))) -> DataFrame:
    """The pairs (cam_idx, i, j, k) whose voxel passes in these of its nine points."""
    some = tested(query_points(pairs, r, "cam_idx").where(F.col("point").isin(*points)), cameras, depth, masks, size)
    return some.groupBy("cam_idx", *IJK).agg(F.bool_and("ok").alias("proved")).where("proved").select("cam_idx", *IJK)


def free_evidence(cameras: DataFrame, depth: DataFrame, r: int, occupied: DataFrame | None = None, masks: DataFrame | None = None, size: tuple[int, int] = (0, 0), made: list | None = None) -> DataFrame:
    """(i, j, k) of the voxels, not occupied, that some camera proves empty. depth: (cam_idx, row, col, depth), rendered; masks:
    (cam_idx, row, col, mask) of this width and height. A list given as `made` is told the
    rows of every turn, of blocks and then of points."""
    spark, r = cameras.sparkSession, resolution(r)
    cameras = cameras.select(*CAMERA)
    sizes = cameras.select("cam_idx", "width", "height")
    depths = kept(pyramid(depth.select("cam_idx", "row", "col", F.col("depth").alias("end")), sizes), "pyramid")
    ons = None
    if masks is not None:
        on = masks.where("mask").select("cam_idx", "row", "col", F.lit(1.0).alias("end"))
        ons = kept(pyramid(on, masks.select("cam_idx", F.lit(size[0]).alias("width"), F.lit(size[1]).alias("height")).distinct()), "mask-pyramid")
        cameras = cameras.join(small(masks.select("cam_idx", F.lit(True).alias("has_mask")).distinct()), "cam_idx", "left")
    side = 1 << max(0, (r - 1).bit_length() - FIRST_HALVINGS)
    n = -(-r // side)
    number = F.col("id")
    start = spark.range(n**3).select((number / (n * n)).cast("int").alias("i"), ((number / n).cast("long") % n).cast("int").alias("j"), (number % n).cast("int").alias("k"))
    rows = start.join(small(cameras.select("cam_idx")))
    found = []
    while side > 1:
        if made is not None:
            made.append(rows.count())
        looked = verdicts(blocks(rows.join(small(cameras), "cam_idx"), side, r), depths, ons, size).where("proved or open").select("cam_idx", *IJK, "proved")
        looked = kept(looked, "blocks")
        proved = looked.where("proved").select(*IJK).distinct()
        found.append((proved, side))
        rows = looked.where("not proved").select("cam_idx", *IJK).join(proved, list(IJK), "left_anti")
        side //= 2
        for s in IJK:
            rows = rows.withColumn(s, F.explode(F.array(F.col(s) * 2, F.col(s) * 2 + 1))).where(F.col(s) * side < r)
    for points in TURNS:
        if made is not None:
            made.append(len(points) * rows.count())
        rows = kept(passing(rows, cameras, depth, r, masks, size, points), "passing")
    out = rows.select(*IJK).distinct()
    for proved, side in found:
        for s in IJK:
            proved = proved.withColumn(s, F.explode(F.sequence(F.col(s) * side, F.least((F.col(s) + 1) * side, F.lit(r)) - 1)))
        out = out.unionByName(proved.select(*[F.col(s).cast("int").alias(s) for s in IJK]))
    return out if occupied is None else out.join(occupied.select(*IJK).distinct(), list(IJK), "left_anti")
