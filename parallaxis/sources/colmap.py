"""Structure-from-motion text folders: cameras.txt and images.txt, read and written by Spark's text source."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import camera as c
from ..functions import vector as v
from ..operators import small


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, line) of a small text file, in its order."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\n")).alias("at", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"\s+", " ")))


def cameras(spark: SparkSession, path: str) -> DataFrame:
    """Intrinsics of PINHOLE and SIMPLE_PINHOLE cameras; comments, short lines and other models are skipped."""
    p = F.split("line", " ")
    at = lambda i: F.get(p, F.lit(i))
    model, n = at(1), F.size(p)
    full, simple = (model == "PINHOLE") & (n >= 8), (model == "SIMPLE_PINHOLE") & (n >= 7)
    rows = _lines(spark, path).where((F.col("line") != "") & ~F.col("line").startswith("#")).where(full | simple)
    number = lambda i: at(i).cast("double")
    return rows.select(
        at(0).cast("int").alias("camera_id"), model.alias("model"), at(2).cast("int").alias("width"), at(3).cast("int").alias("height"), number(4).alias("fx"),
        F.when(full, at(5)).otherwise(at(4)).cast("double").alias("fy"), F.when(full, at(6)).otherwise(at(5)).cast("double").alias("cx"), F.when(full, at(7)).otherwise(at(6)).cast("double").alias("cy"),
    )


def images(spark: SparkSession, path: str) -> DataFrame:
    """Poses of images: every record is followed by a line of points, whatever it holds; lines of under ten words are
    skipped without one. Which lines are records depends on all before them, so a file's lines are folded in order."""
    whole = spark.read.text(path, wholetext=True)
    lines = F.transform(F.split("value", "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    start = F.struct(F.lit(False).alias("skip"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc, line):
        record = ~acc["skip"] & (line != "") & ~line.startswith("#") & (F.size(F.split(line, " ")) >= 10)
        return F.struct(record.alias("skip"), F.when(record, F.concat(acc["out"], F.array(line))).otherwise(acc["out"]).alias("out"))

    p = F.split("line", " ")
    rows = whole.select(F.explode(F.aggregate(lines, start, step)["out"]).alias("line"))
    numbers = [p[i + 1].cast("double").alias(n) for i, n in enumerate(("qw", "qx", "qy", "qz", "tx", "ty", "tz"))]
    return rows.select(p[0].cast("int").alias("image_id"), *numbers, p[8].cast("int").alias("camera_id"), p[9].alias("name"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Camera rows in order of their file's name; images of unknown cameras drop out."""
    joined = images(spark, f"{folder}/images.txt").join(small(cameras(spark, f"{folder}/cameras.txt")), "camera_id")
    q = v.cols("qw", "qx", "qy", "qz")
    n = F.sqrt(v.dot(q, q))
    r = c.rotation_of(tuple(x / n for x in q))
    # y and z of the camera frame point the other way in these files
    signs = (1.0, -1.0, -1.0)
    rows = [[*(x * s for x in row), t * s] for row, t, s in zip(r, v.cols("tx", "ty", "tz"), signs, strict=True)]
    w2c = v.flat([*rows, [F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]])
    fovy = F.degrees(2 * F.atan(F.col("height") / (2 * F.col("fy"))))
    return joined.select(
        "image_id", F.regexp_replace("name", r"\.[^.]*$", "").alias("image_name"), "width", "height", c.fovx_of(F.col("fx"), F.col("width")).alias("fovx_deg"),
        F.when(F.abs(F.col("fy") - F.col("fx")) > 1e-9, fovy).alias("fovy_deg"), "cx", "cy", w2c.alias("w2c"),
    ).orderBy("image_name")


def poses(frame: DataFrame) -> DataFrame:
    """cam_idx with quaternion (w >= 0) and translation in these files' convention."""
    flipped = frame.withColumn("w2c", c.flip("w2c", c.CAMERA_FRAME))
    return flipped.select("cam_idx", *[x.alias(n) for x, n in zip((*c.quaternion(c.rotation()), *c.translation()), ("qw", "qx", "qy", "qz", "tx", "ty", "tz"), strict=True)])


def _write_file(lines: DataFrame, path: str) -> None:
    """Lines as one plain text file: written by one task beside it, then moved to its name."""
    spark = lines.sparkSession
    beside = f"{path}.{uuid.uuid4().hex}"
    lines.coalesce(1).write.text(beside)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(beside)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith("part-"))
    target, old = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{beside}.old")
    # the old file stays beside until the new one has its name
    if fs.exists(target):
        fs.rename(target, old)
    if not fs.rename(part, target):
        fs.rename(old, target)
        raise OSError(f"{path}: could not be written")
    fs.delete(old, True)
    fs.delete(at, True)


def write(frame: DataFrame, folder: str) -> None:
    """cameras.txt with the first camera's intrinsics for all, and images.txt with two lines per image. One file each, in
    order: these are lists of views, not data. An existing folder is replaced."""
    first = frame.orderBy("cam_idx").limit(1)
    line = F.concat_ws(" ", F.lit("1 PINHOLE"), "width", "height", c.fx(), c.fy(), "cx", "cy")
    _write_file(first.select(F.concat(F.lit("# CAMERA_ID MODEL WIDTH HEIGHT PARAMS\n"), line)), f"{folder}/cameras.txt")
    rows = poses(frame).withColumn("name", F.concat(F.format_string("%06d", F.col("cam_idx") + 1), F.lit(".png")))
    lines = rows.orderBy("cam_idx").select(F.concat(F.concat_ws(" ", F.col("cam_idx") + 1, "qw", "qx", "qy", "qz", "tx", "ty", "tz", F.lit(1), "name"), F.lit("\n")))
    _write_file(lines, f"{folder}/images.txt")
