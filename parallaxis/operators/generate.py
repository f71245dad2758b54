"""Generators: sphere directions and random samples, from ranges."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as v

GOLDEN_ANGLE = pi * (3 - sqrt(5))


def fibonacci_polars(spark: SparkSession, n: int) -> DataFrame:
    """n points (idx, phi, theta) spread over the sphere by the golden angle; a single one is on the equator."""
    i = F.col("id").cast("double")
    z = 1 - 2 * i / F.lit(float(max(n - 1, 1))) if n > 1 else F.lit(0.0)
    return spark.range(max(0, n)).select(F.col("id").alias("idx"), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z))).alias("phi"), (i * F.lit(GOLDEN_ANGLE)).alias("theta"))


def polar_direction(phi: Column, theta: Column) -> v.Vec:
    return F.sin(phi) * F.sin(theta), F.sin(phi) * F.cos(theta), F.cos(phi)


def fibonacci_directions(spark: SparkSession, n: int) -> DataFrame:
    p = fibonacci_polars(spark, n)
    return p.select("idx", *[x.alias(a) for x, a in zip(polar_direction(F.col("phi"), F.col("theta")), "xyz", strict=True)])


def fibonacci_rotations(spark: SparkSession, n: int) -> DataFrame:
    """(idx, rotation): a turn about y by theta, then about z by phi, for each of the n points; row-major."""
    p = fibonacci_polars(spark, n)
    a, b, s, t = F.cos("phi"), F.sin("phi"), F.cos("theta"), F.sin("theta")
    return p.select("idx", v.flat([[a * s, -b, a * t], [b * s, a, b * t], [-t, F.lit(0.0), s]]).alias("rotation"))


def random_ups(df: DataFrame, seed: int, name: str = "up") -> DataFrame:
    """Adds a random unit vector per row: three normal numbers, scaled."""
    rows = df.withColumns({f"_{a}": F.randn(seed + k) for k, a in enumerate("xyz")})
    return rows.withColumn(name, F.array(*v.unit(v.cols("_x", "_y", "_z"), 1e-12))).drop("_x", "_y", "_z")


def random_fill(df: DataFrame, segments: list[tuple[float, float, float]], seed: int, name: str = "fill") -> DataFrame:
    """Adds a random number per row: a segment (low, high, weight) by its weight, then evenly within it."""
    total = sum(w for _, _, w in segments)
    pick, at, out, done = F.rand(seed) * total, F.rand(seed + 1), None, 0.0
    rows = df.withColumns({"_p": pick, "_q": at})
    for low, high, w in segments:
        done += w
        value = low + (high - low) * F.col("_q")
        out = F.when(F.col("_p") < done, value) if out is None else out.when(F.col("_p") < done, value)
    return rows.withColumn(name, F.coalesce(out, F.lit(float(segments[-1][1])))).drop("_p", "_q")


def sample_cameras(spark: SparkSession, n: int, seed: int, radius: float = 1.0, width: int = 512, height: int = 512, upper_share: float = 0.5, wedge: tuple[float, float] | None = None, wedge_share: float = 1.0, fill: list[tuple[float, float, float]] = ((0.5, 0.9, 1.0),), distance: float = 2.5, spare: int = 20) -> DataFrame:
    """n cameras that look at the origin, where a ball of this radius is: drawn, without repetition, from spare * n spread-out
    directions, with upper_share of draws from the upper half alone and wedge_share of them from a sector of azimuths
    (centre, share of the circle); fields of view by a random share of the image that the ball fills. The same for the same
    seed and partitions."""
    from ..functions import camera as c

    p = fibonacci_polars(spark, n * spare)
    p = p.withColumns({"_u": F.rand(seed), "_w": F.rand(seed + 1), "_o": F.rand(seed + 2)})
    good = (F.col("_u") >= upper_share) | (F.cos("phi") >= 0)
    if wedge:
        good = good & ((F.col("_w") >= wedge_share) | in_azimuth_wedge(F.col("theta"), *wedge))
    rows = random_fill(p.where(good).orderBy("_o", "idx").limit(n), list(fill), seed + 3)
    tangent = F.lit(radius) / (F.greatest(F.col("fill"), F.lit(1e-6)) * distance * radius)
    fov = F.greatest(F.lit(1.0), F.least(F.lit(170.0), F.degrees(2 * F.atan(tangent))))
    return rows.select(
        F.col("idx").cast("int").alias("cam_idx"), F.lit(width).alias("width"), F.lit(height).alias("height"), fov.alias("fovx_deg"), F.lit(None).cast("double").alias("fovy_deg"),
        F.lit(width / 2).alias("cx"), F.lit(height / 2).alias("cy"), c.polar_pose(F.col("phi"), F.col("theta"), F.lit(distance * radius), v.lit3(0, 0, 0)).alias("w2c"),
    )


def in_azimuth_wedge(azimuth: Column, centre: float, share: float) -> Column:
    """Whether an azimuth lies in the sector of this share of the circle around a centre."""
    return F.abs(F.pmod(azimuth - centre + pi, F.lit(2 * pi)) - pi) <= share * pi


def fov_of_fill(radius: Column | float, distance: Column | float, share: float, least: float = 1.0, most: float = 170.0) -> Column:
    """Field of view in degrees in which a sphere fills this share of the image."""
    tangent = F.lit(radius) / (max(share, 1e-6) * F.greatest(F.lit(distance), F.lit(1e-6)))
    return F.greatest(F.lit(least), F.least(F.lit(most), F.degrees(2 * F.atan(tangent))))


def frustum_points(spark: SparkSession, n: int, near: float, far: float, seed: int) -> DataFrame:
    """Random (u, v, depth) within a frustum, the same for the same seed and partitions."""
    return spark.range(n).select(F.col("id").alias("point_id"), F.rand(seed).alias("u"), F.rand(seed + 1).alias("v"), (near + F.rand(seed + 2) * (far - near)).alias("depth"))


def points_ahead(cameras: DataFrame, n: int, near: float, far: float, seed: int) -> DataFrame:
    """(cam_idx, point_id, x, y, z): n random points of each camera's view in the world, between two distances before its plane;
    the same for the same seed and partitions."""
    from ..functions import camera as c

    rows = cameras.withColumn("point_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n > 0 else cameras.withColumn("point_id", F.lit(0)).where("false")
    rows = rows.withColumns({"_u": F.rand(seed), "_v": F.rand(seed + 1), "_d": near + F.rand(seed + 2) * (far - near)})
    at = c.back_project(F.col("_u"), F.col("_v"), F.col("_d"))
    return rows.select("cam_idx", "point_id", *[x.alias(a) for x, a in zip(at, "xyz", strict=True)])
