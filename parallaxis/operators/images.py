"""Rasters as pixel tables (cam_idx, row, col, values)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import camera as c
from ..functions import vector as v
from .filters import lower_quantile

NEAR, FAR = 1e-5, 1e5


def valid_depth(name: str = "depth") -> Column:
    return (F.col(name) > NEAR) & (F.col(name) < FAR)


def pixel_uv(width: Column | int, height: Column | int) -> tuple[Column, Column]:
    """Centre of the pixel (row, col); row 0 is at the top."""
    return (F.col("col") + 0.5) / width, 1 - (F.col("row") + 0.5) / height


def erode(mask: DataFrame, n: int) -> DataFrame:
    """Mask pixels whose whole (2n + 1)^2 neighbourhood is in the mask; beyond the raster nothing is."""
    k = 2 * n + 1
    out = mask
    for along, across in (("col", "row"), ("row", "col")):
        line = Window.partitionBy("cam_idx", across).orderBy(along).rangeBetween(-n, n)
        out = out.withColumn("filled", F.count(F.when(F.col("mask"), 1)).over(line)).withColumn("mask", F.col("filled") == k).drop("filled")
    return out


def depth_mask(pixels: DataFrame, share: float) -> DataFrame:
    """Pixels with a valid depth, inside the mask, whose confidence reaches the lower quantile of all of their camera's."""
    return inside_depth(pixels, share).where("inside").drop("inside")


def with_mask(pixels: DataFrame, masks: DataFrame, size: tuple[int, int], mask_size: tuple[int, int]) -> DataFrame:
    """Adds mask from rasters (cam_idx, row, col, mask) of another width and height, looked up at the pixel nearest to each
    pixel's centre. Cameras without a mask see all; a missing pixel of a mask is off."""
    from . import small

    u, w = pixel_uv(*size)
    near = pixels.drop("mask").withColumns({"_r": c.nearest_pixel(1 - w, F.lit(mask_size[1])), "_c": c.nearest_pixel(u, F.lit(mask_size[0]))})
    on = masks.select("cam_idx", F.col("row").alias("_r"), F.col("col").alias("_c"), "mask")
    has = small(masks.select("cam_idx").distinct().withColumn("_has", F.lit(True)))
    rows = near.join(on, ["cam_idx", "_r", "_c"], "left").join(has, "cam_idx", "left")
    return rows.withColumn("mask", F.when(F.col("_has"), F.coalesce("mask", F.lit(False))).otherwise(True)).drop("_r", "_c", "_has")


def inside_depth(pixels: DataFrame, share: float | None = None) -> DataFrame:
    """Adds inside: a valid depth, in the mask if there is one, and a confidence that reaches the lower quantile if share is given."""
    good = valid_depth() & (F.col("mask") if "mask" in pixels.columns else F.lit(True))
    if share is None:
        return pixels.withColumn("inside", F.coalesce(good, F.lit(False)))
    least = lower_quantile(pixels, "cam_idx", "conf", share, "least")
    return pixels.join(least, "cam_idx").withColumn("inside", F.coalesce(good & (F.col("conf") >= F.col("least")), F.lit(False))).drop("least")


def resample(pixels: DataFrame, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """The raster at another size by the nearest pixel: each new pixel joins the one nearest to its centre. Every camera has
    all new pixels, null where the raster has none."""
    rows = pixels.select("cam_idx").distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(to_height - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(to_width - 1))))
    u, w = pixel_uv(to_width, to_height)
    near = rows.withColumns({"_r": c.nearest_pixel(1 - w, F.lit(height)), "_c": c.nearest_pixel(u, F.lit(width))})
    return near.join(pixels.withColumnsRenamed({"row": "_r", "col": "_c"}), ["cam_idx", "_r", "_c"], "left").drop("_r", "_c")


def resize(pixels: DataFrame, width: int, height: int, to_width: int, to_height: int, names: list[str]) -> DataFrame:
    """The raster at another size, each new pixel mixed of the four around its centre; beyond the border the border counts.
    Each pixel goes to the new pixels it has a share in, so one shuffle adds them up; of a missing pixel's share the others
    take over."""
    def shares(n: int, to: int) -> Column:
        """(place, share) pairs of the two old places around each new one."""
        at = F.greatest(F.lit(0.0), (F.col("t") + 0.5) * (n / to) - 0.5)
        lo = F.least(F.floor(at), F.lit(n - 1))
        return F.array(F.struct(lo.alias("at"), (1 - (at - lo)).alias("share")), F.struct(F.least(lo + 1, F.lit(n - 1)).alias("at"), (at - lo).alias("share")))

    spark = pixels.sparkSession

    def table(n: int, to: int, name: str) -> DataFrame:
        rows = spark.range(to).withColumnRenamed("id", "t").select(F.col("t").alias(f"to_{name}"), F.explode(shares(n, to)).alias("s"))
        return rows.groupBy(f"to_{name}", F.col("s.at").cast("int").alias(name)).agg(F.sum("s.share").alias(f"{name}_share")).where(f"{name}_share > 0")

    rows = pixels.select("cam_idx", "row", "col", *names).join(F.broadcast(table(height, to_height, "row")), "row").join(F.broadcast(table(width, to_width, "col")), "col")  # at most two rows per new row or column
    share = F.col("row_share") * F.col("col_share")
    out = rows.groupBy("cam_idx", F.col("to_row").cast("int").alias("row"), F.col("to_col").cast("int").alias("col"))
    return out.agg(*[(F.sum(share * F.col(n)) / F.sum(F.when(F.col(n).isNotNull(), share))).alias(n) for n in names])


def masked(pixels: DataFrame, names: list[str], fill: float = 0.0) -> DataFrame:
    """Values inside (see inside_depth), elsewhere the fill."""
    return pixels.withColumns({n: F.when(F.col("inside"), F.col(n)).otherwise(F.lit(float(fill))) for n in names})


def point_colors(points: DataFrame, fill: float = 1.0) -> DataFrame:
    """World points x, y, z as colours: half a unit on, within 0 and 1; outside the fill."""
    return points.withColumns({n: F.when(F.col("inside"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(n) + 0.5))).otherwise(F.lit(float(fill))) for n in "xyz"})


def normal_colors(normals: DataFrame, mask: str | None = "mask", fill: float = 1.0) -> DataFrame:
    """Normals nx, ny, nz as colours: from -1..1 to 0..1; outside the mask the fill."""
    inside = F.coalesce(F.col(mask), F.lit(False)) if mask else F.lit(True)
    return normals.withColumns({n: F.when(inside, F.col(n) * 0.5 + 0.5).otherwise(F.lit(float(fill))) for n in ("nx", "ny", "nz")})


def turn_normals(normals: DataFrame, cameras: DataFrame, to_world: bool) -> DataFrame:
    """Normals (nx, ny, nz) from the world's frame to their camera's, or back."""
    from . import small

    rows = normals.join(small(cameras.select("cam_idx", "w2c")), "cam_idx")
    r = c.rotation()
    axes = [tuple(r[i][j] for i in range(3)) for j in range(3)] if to_world else r
    turned = [v.dot(a, v.cols("nx", "ny", "nz")) for a in axes]
    return rows.select(*[n for n in normals.columns if n not in ("nx", "ny", "nz")], *[x.alias(n) for x, n in zip(turned, ("nx", "ny", "nz"), strict=True)])


def clamp_normals(normals: DataFrame) -> DataFrame:
    return normals.withColumns({n: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(n))) for n in ("nx", "ny", "nz")})


def query_pixels(at: DataFrame, pixels: DataFrame, cameras: DataFrame, width: int, height: int) -> DataFrame:
    """World point, confidence and validity at places (cam_idx, u, v) of depth rasters: the pixel that covers the place, seen
    in its depth. Places beyond the raster take its border; other columns of at stay."""
    from . import small

    rows = at.withColumns({"row": c.covering_pixel(1 - F.col("v"), F.lit(height)), "col": c.covering_pixel(F.col("u"), F.lit(width))})
    rows = rows.join(pixels.select("cam_idx", "row", "col", "depth", "conf"), ["cam_idx", "row", "col"]).join(small(cameras), "cam_idx")
    point = c.back_project(F.col("u"), F.col("v"), F.col("depth"))
    return rows.select(*at.columns, *[x.alias(n) for x, n in zip(point, "xyz", strict=True)], "conf", valid_depth().alias("valid"))


def depth_points(pixels: DataFrame, cameras: DataFrame, width: int, height: int, share: float | None = None) -> DataFrame:
    """World points with confidence of the pixels inside."""
    inside = inside_depth(pixels, share).where("inside")
    return world_points(inside, cameras, width, height).join(inside.select("cam_idx", "row", "col", "conf"), ["cam_idx", "row", "col"])


def depth_cloud(pixels: DataFrame, cameras: DataFrame, width: int, height: int, share: float | None = 0.8, colors: DataFrame | None = None, normals: DataFrame | None = None) -> DataFrame:
    """One cloud of all cameras' inside pixels. Colours (r, g, b) and normals (nx, ny, nz), rasters of the depth's size, are
    columns only if every camera has them."""
    cloud = depth_points(pixels, cameras, width, height, share)
    for extra, names in ((colors, ("r", "g", "b")), (normals, ("nx", "ny", "nz"))):
        if extra is not None and cloud.select("cam_idx").distinct().join(extra.select("cam_idx").distinct(), "cam_idx", "left_anti").isEmpty():
            cloud = cloud.join(extra.select("cam_idx", "row", "col", *names), ["cam_idx", "row", "col"], "left")
    return cloud


def world_points(pixels: DataFrame, cameras: DataFrame, width: int, height: int) -> DataFrame:
    """World point of every depth pixel."""
    from . import small

    u, w = pixel_uv(width, height)
    at = c.back_project(u, w, F.col("depth"))
    rows = pixels.join(small(cameras), "cam_idx")
    return rows.select("cam_idx", "row", "col", *[x.alias(n) for x, n in zip(at, "xyz", strict=True)])


def normalized(pixels: DataFrame, value: str, name: str, inside: Column | None = None, fill: float = 1.0, low: float | None = None, high: float | None = None) -> DataFrame:
    """Value between 0 and 1 over the range it has inside in its camera, or over the range given; outside the fill. Inside is
    by default where the value is a valid depth. The ranges are one aggregate, so a camera is no single task's work."""
    from . import small

    inside = F.coalesce(valid_depth(value) if inside is None else inside, F.lit(False))
    bounds = pixels.where(inside).groupBy("cam_idx").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    lo, hi = (F.col(n) if given is None else F.lit(float(given)) for n, given in (("_lo", low), ("_hi", high)))
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value) - lo) / (hi - lo + 1e-8)))
    return pixels.join(small(bounds), "cam_idx", "left").withColumn(name, F.when(inside, at).otherwise(F.lit(float(fill)))).drop("_lo", "_hi")


def crop_box(mask: DataFrame, width: int, height: int, margin: int = 0) -> DataFrame:
    """Per camera the box of the mask's pixels with a margin, clipped to the raster; without mask pixels the whole raster."""
    on = F.col("mask")
    b = mask.groupBy("cam_idx").agg(*[f(F.when(on, F.col(a))).alias(f"{k}_{a}") for a in ("row", "col") for k, f in (("lo", F.min), ("hi", F.max))])
    side = lambda a, n: [F.coalesce(F.greatest(F.lit(0), F.col(f"lo_{a}") - margin), F.lit(0)).alias(f"{a}0"), F.coalesce(F.least(F.lit(n - 1), F.col(f"hi_{a}") + margin), F.lit(n - 1)).alias(f"{a}1")]
    return b.select("cam_idx", *side("row", height), *side("col", width))


def crop(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    rows = pixels.join(boxes, "cam_idx").where("row between row0 and row1 and col between col0 and col1")
    return rows.withColumns({"row": F.col("row") - F.col("row0"), "col": F.col("col") - F.col("col0")}).drop("row0", "row1", "col0", "col1")


def foreground(pixels: DataFrame, width: int, height: int, background: dict[str, float], threshold: float, margin: int = 0) -> DataFrame:
    """Per camera the box around the pixels that differ from the background by more than threshold / 255 in some channel, with
    a margin; what of the margin lies beyond the raster is background. Without such pixels nothing is left."""
    differs = F.array_max(F.array(*[F.abs(F.col(n) - x) for n, x in background.items()])) > threshold / 255
    box = pixels.where(differs).groupBy("cam_idx").agg(*[f(a).alias(f"{k}_{a}") for a in ("row", "col") for k, f in (("lo", F.min), ("hi", F.max))])
    span = lambda a: F.sequence(F.col(f"lo_{a}") - margin, F.col(f"hi_{a}") + margin)
    grid = box.withColumn("row", F.explode(span("row"))).withColumn("col", F.explode(span("col")))
    rows = grid.join(pixels.select("cam_idx", "row", "col", *background), ["cam_idx", "row", "col"], "left")
    return rows.select("cam_idx", (F.col("row") - F.col("lo_row") + margin).alias("row"), (F.col("col") - F.col("lo_col") + margin).alias("col"), *[F.coalesce(n, F.lit(float(x))).alias(n) for n, x in background.items()])


def unpad(pixels: DataFrame, places: DataFrame) -> DataFrame:
    """The inverse of letterboxing, before resizing: the pixels of each image's place (cam_idx, x1, y1, x2, y2), from 0 on."""
    rows = pixels.join(places.select("cam_idx", "x1", "y1", "x2", "y2"), "cam_idx").where("col >= x1 and col < x2 and row >= y1 and row < y2")
    return rows.withColumns({"row": F.col("row") - F.col("y1"), "col": F.col("col") - F.col("x1")}).drop("x1", "y1", "x2", "y2")


def letterbox(width: Column, height: Column, to_width: int, to_height: int) -> dict[str, Column]:
    """Place and size of an image fitted into a canvas with its aspect kept."""
    s = F.least(F.lit(float(to_width)) / width, F.lit(float(to_height)) / height)
    w, h = (F.greatest(F.lit(1), F.least(F.lit(most), F.bround(x * s).cast("int"))) for x, most in ((width, to_width), (height, to_height)))
    x1, y1 = F.floor((to_width - w) / 2).cast("int"), F.floor((to_height - h) / 2).cast("int")
    return {"x1": x1, "y1": y1, "x2": x1 + w, "y2": y1 + h, "w": w, "h": h}


def to_byte(x: Column) -> Column:
    """0..1 to 0..255 by truncation, clamped."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), x * 255))).cast("int")
