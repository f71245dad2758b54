"""Points, cameras, triangles and depth pixels derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import camera as c
from ..functions import vector as v

WIDTH, HEIGHT, FOVX = 128, 96, 60.0
GOLDEN = 2.399963229728653


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def component(i: int):
    return F.col("embedding")[i].cast("double")


def points(spark: SparkSession, sf_dir: str, scale: float = 1.0) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), *[(component(i) * scale).alias(n) for i, n in enumerate("xyz")])


def dense_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        ((F.col("l_quantity") - 25.5) / 49.0).alias("x"), ((F.col("l_extendedprice") - 52500.0) / 105000.0).alias("y"), (F.col("l_discount") / F.lit(0.1) - 0.5).alias("z")
    )


def cameras(spark: SparkSession, sf_dir: str, radius: float = 2.5, phase: float = 0.0) -> DataFrame:
    n = F.col("n_nationkey")
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - 2 * n / F.lit(24.0))))
    return read(spark, sf_dir, "nation").select(
        n.cast("int").alias("cam_idx"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.lit(FOVX).alias("fovx_deg"), F.lit(None).cast("double").alias("fovy_deg"),
        F.lit(WIDTH / 2).alias("cx"), F.lit(HEIGHT / 2).alias("cy"), c.polar_pose(phi, n * F.lit(GOLDEN) + phase, F.lit(radius), v.lit3(0, 0, 0)).alias("w2c"),
    )


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"{a}{k}" for k in range(3) for a in "xyz"]
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("face_id"), *[component(i).alias(n) for i, n in enumerate(names)])


def depth_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return read(spark, sf_dir, "events").select(
        F.floor(e / 1000).cast("int").alias("cam_idx"), F.floor((e % 1000) / 40).cast("int").alias("row"), (e % 40).cast("int").alias("col"),
        (1 + F.col("value") / 200).alias("depth"), F.col("value").alias("conf"), (F.col("event_type") != "error").alias("mask"),
    )
