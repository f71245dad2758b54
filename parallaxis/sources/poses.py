"""Camera lists in other files: JSON records, text matrices of single views, tables of stacked matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import camera as c
from ..functions import vector as v

RECORD = "cam_idx int, image_id string, width int, height int, fovx_deg double, fovy_deg double, cx double, cy double, w2c array<double>"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Cameras of JSON lines; a record without a principal point has it in the middle of its image."""
    rows = spark.read.schema(RECORD).json(path)
    return rows.withColumns({"cx": F.coalesce("cx", F.col("width") / 2), "cy": F.coalesce("cy", F.col("height") / 2)})


def write_records(cameras: DataFrame, path: str, overwrite: bool = False) -> None:
    """Cameras as JSON lines; an existing folder is left as it is unless it may be overwritten."""
    have = [x.split()[0] for x in RECORD.split(", ") if x.split()[0] in cameras.columns]
    cameras.select(*have).write.mode("overwrite" if overwrite else "ignore").json(path)


def read_view_texts(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """Cameras of text files, one each: three rows of a 3x4 camera-to-world matrix with y down and z ahead in both frames, then
    a line that starts with the focal length in pixels. file, and the columns of a camera without cam_idx."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split(F.trim("value"), r"\s*\n\s*").alias("lines"))
    numbers = F.transform(F.flatten(F.transform(F.slice("lines", 1, 3), lambda x: F.split(x, r"\s+"))), lambda x: x.try_cast("double"))
    last = F.array(*[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])
    rows = lines.select("file", F.concat(numbers, last).alias("c2w"), F.split(F.get("lines", F.lit(3)), r"\s+")[0].try_cast("double").alias("fx")).where(F.size("c2w") == 16)
    rows = rows.withColumn("c2w", c.flip("c2w", c.BOTH_FRAMES)).withColumn("w2c", c.inverse_pose("c2w"))
    return rows.select("file", F.lit(width).alias("width"), F.lit(height).alias("height"), c.fovx_of(F.col("fx"), F.lit(width)).alias("fovx_deg"), F.lit(None).cast("double").alias("fovy_deg"), F.lit(width / 2).alias("cx"), F.lit(height / 2).alias("cy"), "w2c")


def view_texts(cameras: DataFrame) -> DataFrame:
    """(name, value): each camera's text with its 3x4 camera-to-world matrix and its 3x3 intrinsic matrix, rows of numbers between
    tabs; to be written by name."""
    flipped = cameras.withColumn("c2w", c.inverse_pose()).withColumn("c2w", c.flip("c2w", c.BOTH_FRAMES)).withColumn("k", c.intrinsic_matrix())
    row = lambda m, i, n: F.concat_ws("\t", *[F.col(m)[n * i + j].cast("string") for j in range(n)])
    return flipped.select(F.format_string("%06d", F.col("cam_idx") + 1).alias("name"), F.concat_ws("\n", *[row("c2w", i, 4) for i in range(3)], *[row("k", i, 3) for i in range(3)]).alias("value"))


def write_view_texts(cameras: DataFrame, folder: str) -> None:
    """A folder per camera's name with its text."""
    view_texts(cameras).write.mode("overwrite").partitionBy("name").text(folder)


def stacked(cameras: DataFrame) -> DataFrame:
    """(cam_idx, extrinsic, intrinsic): 4x4 world-to-camera matrices with y down and z ahead in both frames and 3x3 intrinsics, as
    rows of a table that Spark writes."""
    return cameras.select("cam_idx", c.flip("w2c", c.BOTH_FRAMES).alias("extrinsic"), c.intrinsic_matrix().alias("intrinsic"))


def from_stacked(table: DataFrame) -> DataFrame:
    return c.from_matrices(table, "extrinsic", "intrinsic", c.BOTH_FRAMES).drop("extrinsic", "intrinsic")


def check_image_ids(cameras: DataFrame) -> None:
    """All cameras have an image_id, or none has."""
    n, some = cameras.agg(F.count(F.lit(1)), F.count("image_id")).first()
    if some not in (0, n):
        raise ValueError(f"{some} of {n} cameras have an image_id; all or none must")


def directions(df: DataFrame, names: tuple[str, str, str], cameras: DataFrame, to_world: bool) -> DataFrame:
    """Direction columns of rows with a cam_idx turned from the world's frame to their camera's, or back."""
    from ..operators import small

    rows = df.join(small(cameras.select("cam_idx", "w2c")), "cam_idx")
    r = c.rotation()
    axes = [tuple(r[i][j] for i in range(3)) for j in range(3)] if to_world else r
    return rows.withColumns({n: v.dot(a, v.cols(*names)) for n, a in zip(names, axes, strict=True)}).drop("w2c")
