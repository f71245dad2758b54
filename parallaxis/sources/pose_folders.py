"""Pose folders with the rasters beside the poses: images, masks, depths and normals, one file an image, read and written.

    sparse/0/cameras.txt, images.txt          poses
    images/NAME.png, masks/NAME.png           colours, masks
    depths/NAME.npy                           depth and confidence
    normal_worlds/NAME.npy, normal_cameras/   normals in the world and in the camera's frame

Read: Spark lists and reads only the folders of the rasters that are asked for, a file a row, from any store it can reach.
Write: rasters of one image meet in one task, which codes them; a Spark data source of this module writes the files beside the
folder, and on success of all tasks moves them in. So a task that runs twice, or a job that fails, leaves no half folder.
"""

from __future__ import annotations

import io
import os
import shutil
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions import camera as c
from ..operators import images as rasters
from ..operators import small
from ..shipping import send
from ..storage import kept
from . import colmap
from .files import depth_arrays
from .geometry import normal_arrays, png_images, png_masks

FOLDERS = {"images": "png", "masks": "png", "depths": "npy", "normal_worlds": "npy", "normal_cameras": "npy"}
NORMAL = ("nx", "ny", "nz")
READERS = {"images": png_images, "masks": png_masks, "depths": depth_arrays, "normal_worlds": normal_arrays, "normal_cameras": normal_arrays}


def _there(spark: SparkSession, path: str) -> bool:
    """Whether a folder exists and has a file, in any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(at) and len(fs.listStatus(at)) > 0


def read(spark: SparkSession, folder: str, kinds: Sequence[str] = ("images", "masks", "depths", "normals")) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Cameras (cam_idx in order of their names) and the asked-for rasters (cam_idx, row, col, values), those that the folder
    has. Asked for images, cameras whose image is missing drop out; other rasters may be missing, for some images or all.
    normals gives normal_worlds and normal_cameras; where a view has one of both, the other follows from it."""
    unknown = set(kinds) - {"images", "masks", "depths", "normals"}
    if unknown:
        raise ValueError(f"no such rasters: {sorted(unknown)}")
    views = kept(colmap.read(spark, f"{folder}/sparse/0"), "views")
    wanted = [k for k in ("images", "masks", "depths") if k in kinds] + (["normal_worlds", "normal_cameras"] if "normals" in kinds else [])
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    found = {k: READERS[k](spark, f"{folder}/{k}/*.{FOLDERS[k]}").withColumn("image_name", F.url_decode(stem)).drop("file") for k in wanted if _there(spark, f"{folder}/{k}")}
    if "images" in kinds:
        if "images" not in found:
            views = views.limit(0)
        else:
            # the names of the files say which images are there; nothing is decoded for it
            listed = spark.read.format("binaryFile").load(f"{folder}/images/*.png").select(F.col("path").alias("file"))
            views = views.join(listed.select(F.url_decode(stem).alias("image_name")).distinct(), "image_name", "left_semi")
    views = kept(views.withColumn("cam_idx", (F.row_number().over(Window.orderBy("image_name")) - 1).cast("int")), "views")
    number = views.select("image_name", "cam_idx")
    out = {k: df.join(small(number), "image_name").drop("image_name") for k, df in found.items()}
    if "normals" in kinds and ("normal_worlds" in out or "normal_cameras" in out):
        poses, sides = views.select("cam_idx", "w2c"), ("normal_worlds", "normal_cameras")
        own = {k: out[k] for k in sides if k in out}
        for k, other in (sides, sides[::-1]):
            if other in own:
                lone = own[other] if k not in own else own[other].join(small(own[k].select("cam_idx").distinct()), "cam_idx", "left_anti")
                turned = rasters.turn_normals(lone, poses, to_world=k == "normal_worlds").select("cam_idx", "row", "col", *NORMAL)
                out[k] = turned if k not in own else own[k].select("cam_idx", "row", "col", *NORMAL).unionByName(turned)
    return views, out


def png_bytes(image: np.ndarray) -> bytes:
    """A PNG file of (height, width) or (height, width, 3) bytes."""
    height, width = image.shape[:2]
    lines = np.concatenate([np.zeros((height, 1), np.uint8), np.ascontiguousarray(image, np.uint8).reshape(height, -1)], 1)
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines.tobytes(), 1)) + part(b"IEND", b"")


def npy_bytes(values: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, values, allow_pickle=False)
    return out.getvalue()


@dataclass
class Written(WriterCommitMessage):
    """The files of one task, as (place while written, place in the folder)."""

    files: list


class FilesWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.beside = folder, f"{folder}.{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        own, files = uuid.uuid4().hex, []
        for r in rows:
            place = os.path.join(self.beside, own, r["name"])
            os.makedirs(os.path.dirname(place), exist_ok=True)
            with open(place, "wb") as f:
                f.write(r["content"])
            files.append((place, r["name"]))
        return Written(files)

    def commit(self, messages: list) -> None:
        for m in messages:
            for place, name in m.files if m else []:
                target = os.path.join(self.folder, name)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                os.replace(place, target)
        shutil.rmtree(self.beside, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.beside, ignore_errors=True)


class FilesSource(DataSource):
    """Rows (name, content) as files of these names under a folder that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "parallaxis_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"])


def _coded(df: DataFrame, folder: str, values: Sequence[str], names: DataFrame) -> DataFrame:
    """(name, content): every image's raster as one file. The raster of an image is a group: it is one file."""
    columns = list(values)

    def code(pdf: pd.DataFrame) -> pd.DataFrame:
        shape = (int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1)
        a = np.zeros((*shape, len(columns)))
        a[pdf["row"], pdf["col"]] = pdf[columns].to_numpy(float)
        if FOLDERS[folder] == "png":
            whole = np.clip(np.round(a * 255), 0, 255).astype(np.uint8)
            content = png_bytes(whole if len(columns) > 1 else whole[:, :, 0])
        else:
            content = npy_bytes(a.astype(np.float32))
        return pd.DataFrame({"name": [f"{folder}/{pdf['image_name'].iloc[0]}.{FOLDERS[folder]}"], "content": [content]})

    rows = df.select("cam_idx", "row", "col", *[F.col(x).cast("double").alias(x) for x in columns]).join(small(names), "cam_idx")
    return rows.groupBy("cam_idx").applyInPandas(code, "name string, content binary")


def write(folder: str, cameras: DataFrame, images: DataFrame | None = None, masks: DataFrame | None = None, depths: DataFrame | None = None, normals: DataFrame | None = None, points: DataFrame | None = None) -> None:
    """A pose folder at a path of a file system that driver and executors share. cameras may have image_id, all or none: it names
    the files, else their order does. images: (cam_idx, row, col, r, g, b), 0 to 1; masks: mask; depths: depth and, if there,
    conf; normals: nx, ny, nz in the world, of which those in the camera's frame follow; points: (x, y, z) for points3D.ply.
    Where a raster is missing its folder is not written; files of a former write that have no successor stay."""
    spark = cameras.sparkSession
    send(spark)
    spark.dataSource.register(FilesSource)
    rows = cameras if "image_id" in cameras.columns else cameras.withColumn("image_id", F.lit(None).cast("string"))
    n, named, blanks = rows.agg(F.count(F.lit(1)), F.count("image_id"), F.count_if(F.col("image_id").rlike(r"\s"))).first()
    if named not in (0, n):
        raise ValueError("cameras must all have image_id or none")
    if blanks:
        raise ValueError("names of images must have no blanks: the files' fields are parted by them")
    order = F.row_number().over(Window.orderBy("cam_idx"))
    stem = F.regexp_replace("image_id", r"\.[^./]*$", "") if named else F.format_string("%06d", order)
    rows = kept(rows.withColumns({"n": order, "image_name": stem}), "named")
    names = rows.select("cam_idx", "image_name")
    first = rows.orderBy("cam_idx").limit(1).select("width", "height", c.fx().alias("fx"), c.fy().alias("fy"), "cx", "cy").first()
    lines = colmap.poses(rows).join(rows.select("cam_idx", "n", "image_name"), "cam_idx").orderBy("n")
    text = ["# IMAGE_ID QW QX QY QZ TX TY TZ CAMERA_ID NAME, then a line of points"]
    for r in lines.toLocalIterator():  # a line a camera: the file is one list
        text += [" ".join([str(r["n"]), *[f"{r[k]:.17g}" for k in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")], "1", f"{r['image_name']}.png"]), ""]
    files = {"sparse/0/images.txt": "\n".join(text) + "\n"}
    if first:
        files["sparse/0/cameras.txt"] = "# CAMERA_ID MODEL WIDTH HEIGHT PARAMS\n" + " ".join(["1 PINHOLE", str(first["width"]), str(first["height"]), *[f"{first[k]:.17g}" for k in ("fx", "fy", "cx", "cy")]]) + "\n"
    out = spark.createDataFrame([(k, bytearray(x.encode())) for k, x in files.items()], "name string, content binary")
    if images is not None:
        out = out.unionByName(_coded(images, "images", "rgb", names))
    if masks is not None:
        out = out.unionByName(_coded(masks, "masks", ["mask"], names))
    if depths is not None:
        out = out.unionByName(_coded(depths, "depths", [x for x in ("depth", "conf") if x in depths.columns], names))
    if normals is not None:
        out = out.unionByName(_coded(normals, "normal_worlds", NORMAL, names))
        out = out.unionByName(_coded(rasters.turn_normals(normals, cameras.select("cam_idx", "w2c"), to_world=False), "normal_cameras", NORMAL, names))
    if points is not None:
        out = out.unionByName(_ply(points))
    out.write.format("parallaxis_files").option("path", folder).mode("append").save()


def _ply(points: DataFrame) -> DataFrame:
    """points3D.ply in text. Its head holds the number of points and it is one file, so its lines are gathered in one task."""
    n = points.count()
    head = f"ply\nformat ascii 1.0\nelement vertex {n}\nproperty double x\nproperty double y\nproperty double z\nend_header\n"
    line = F.concat_ws(" ", *[F.col(a).cast("double").cast("string") for a in "xyz"])

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = io.StringIO()
        out.write(head)
        for pdf in batches:
            out.writelines(x + "\n" for x in pdf["line"])
        yield pd.DataFrame({"name": ["sparse/0/points3D.ply"], "content": [out.getvalue().encode()]})

    return points.select(line.alias("line")).coalesce(1).mapInPandas(gather, "name string, content binary")
