"""Point, depth, mesh and camera files through Spark's binary and text sources, decoded in Arrow batches."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import send

#: glTF sampler codes and the wrap modes they name.
WRAP_MODES = {33071: "clamp", 33648: "mirror", 10497: "repeat"}


def text_points(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z from white-space separated text, whatever the suffix; comments and short lines are skipped."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.trim("value").startswith("#")).where(F.size(p) >= 3)
    return rows.select(*[p[i].cast("double").alias(n) for i, n in enumerate("xyz")])


def _arrays(content: bytes) -> np.ndarray:
    found = np.load(io.BytesIO(content), allow_pickle=False)
    if isinstance(found, np.lib.npyio.NpzFile):
        return next(found[k] for k in found.files if found[k].ndim == 2 and found[k].shape[-1] >= 3)
    return found


def array_points(spark: SparkSession, path: str) -> DataFrame:
    """file, point_id, x, y, z from .npy files, or the first array of .npz files with three columns or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                a = _arrays(content).astype(np.float64)
                yield pa.record_batch([pa.array([name] * len(a)), pa.array(np.arange(len(a))), *(pa.array(np.ascontiguousarray(a[:, k])) for k in range(3))], ["file", "point_id", "x", "y", "z"])

    send(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, point_id long, x double, y double, z double")


def depth_arrays(spark: SparkSession, path: str) -> DataFrame:
    """file, row, col, depth and conf (1 without a second channel) of .npy depth files; more channels are refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                a = _arrays(content).astype(np.float64)
                a = a[..., None] if a.ndim == 2 else a
                if a.ndim != 3 or a.shape[2] > 2:
                    raise ValueError(f"{name}: a depth file has one channel, or two with confidence")
                h, w, n = a.shape
                row, col = np.divmod(np.arange(h * w, dtype=np.int32), w)
                conf = a[:, :, 1].ravel() if n == 2 else np.ones(h * w)
                yield pa.record_batch([pa.array([name] * (h * w)), pa.array(row), pa.array(col), pa.array(a[:, :, 0].ravel()), pa.array(conf)], ["file", "row", "col", "depth", "conf"])

    send(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, row int, col int, depth double, conf double")


def obj_meshes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (file, vid, x, y, z) and triangles (file, face_id, v0, v1, v2) of OBJ text; polygons are cut into fans,
    negative numbers count from the end."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", "\n").alias("lines"))
    tokens = lambda head: F.transform(F.filter("lines", lambda x: F.trim(x).startswith(head + " ")), lambda x: F.split(F.trim(x), r"\s+"))
    vertices = whole.select("file", F.posexplode(tokens("v")).alias("vid", "p")).select("file", "vid", *[F.get("p", F.lit(i + 1)).try_cast("double").alias(n) for i, n in enumerate("xyz")])
    number = F.size(tokens("v"))
    rows = whole.select("file", number.alias("n"), F.posexplode(tokens("f")).alias("polygon", "p"))
    rows = rows.withColumn("ids", F.transform(F.slice("p", 2, F.size("p") - 1), lambda x: F.split(x, "/")[0].try_cast("int")))
    rows = rows.withColumn("ids", F.transform("ids", lambda i: F.when(i < 0, i + F.col("n")).otherwise(i - 1))).where(F.size("ids") >= 3)
    fans = rows.select("file", "polygon", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("ids") - 2), lambda k: F.array(F.col("ids")[0], F.get("ids", k), F.get("ids", k + 1)))).alias("part", "t"))
    faces = fans.select("file", (F.col("polygon").cast("long") * (1 << 31) + F.col("part")).alias("face_id"), *[F.col("t")[m].alias(f"v{m}") for m in range(3)])
    return vertices, faces


def glb_wrap_modes(spark: SparkSession, path: str) -> DataFrame:
    """file, wrap_s, wrap_t of GLB files, from the first sampler of their JSON chunk: all by byte and JSON functions."""
    b = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    good = (F.hex(F.substring("content", 1, 4)) == "676C5446") & (F.hex(F.substring("content", 17, 4)) == "4A534F4E")
    js = F.when(good, F.expr("cast(substring(content, 21, cast(conv(concat(hex(substring(content, 16, 1)), hex(substring(content, 15, 1)), hex(substring(content, 14, 1)), hex(substring(content, 13, 1))), 16, 10) as int)) as string)"))
    modes = F.create_map(*[F.lit(x) for pair in WRAP_MODES.items() for x in pair])
    code = lambda n: F.coalesce(F.get_json_object(js, f"$.samplers[0].{n}").cast("int"), F.lit(10497))
    mode = lambda n: F.when(F.get_json_object(js, "$.samplers[0]").isNull(), "clamp").otherwise(F.coalesce(F.try_element_at(modes, code(n)), F.lit("clamp")))
    return b.select("file", mode("wrapS").alias("wrap_s"), mode("wrapT").alias("wrap_t"))
