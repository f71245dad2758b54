"""Meshes, point clouds and images from binary files: PLY, GLB and PNG, decoded by numpy in tasks, a file a row."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import send
from ..storage import kept
from .files import array_points, obj_meshes, text_points

#: PLY's names of number types, and glTF's codes of component types and names of shapes. Fixed values.
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
GLTF_TYPES = {5120: "i1", 5121: "u1", 5122: "i2", 5123: "u2", 5125: "u4", 5126: "f4"}
GLTF_SHAPES = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4, "MAT4": 16}
#: PNG colour types and their channels. Fixed values.
PNG_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
ROWS = 50_000


def _fans(polygons: list[np.ndarray]) -> np.ndarray:
    """Triangles of polygons, each cut into a fan from its first corner."""
    out = [np.stack([np.full(len(p) - 2, p[0]), p[1:-1], p[2:]], 1) for p in polygons if len(p) >= 3]
    return np.concatenate(out).astype(np.int64) if out else np.zeros((0, 3), np.int64)


def parse_ply(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Vertices, triangles and colours (0..1; None without) of a PLY file, in text or either byte order."""
    head, _, body = content.partition(b"end_header")
    body = body[body.index(b"\n") + 1 :]
    lines = [x.split() for x in head.decode("ascii", "replace").splitlines()]
    if not lines or lines[0] != ["ply"]:
        raise ValueError("not a PLY file")
    kind = next(x[1] for x in lines if x[:1] == ["format"])
    elements: list[tuple[str, int, list[list[str]]]] = []
    for x in lines:
        if x[:1] == ["element"]:
            elements.append((x[1], int(x[2]), []))
        elif x[:1] == ["property"]:
            elements[-1][2].append(x[1:])
    points, colors, polygons = np.zeros((0, 3)), None, []
    text, at = (body.split(b"\n"), 0) if kind == "ascii" else (None, 0)
    order = ">" if kind == "binary_big_endian" else "<"
    for name, n, properties in elements:
        if not any(p[0] == "list" for p in properties):
            if text is not None:
                table = np.array([x.split()[: len(properties)] for x in text[at : at + n]], float).reshape(n, len(properties))
                column = {p[1]: table[:, k] for k, p in enumerate(properties)}
                at += n
            else:
                row = np.dtype([(p[1], order + PLY_TYPES[p[0]]) for p in properties])
                table = np.frombuffer(body, row, n, at)
                column = {p[1]: table[p[1]].astype(float) for p in properties}
                at += n * row.itemsize
            if name == "vertex":
                points = np.stack([column[a] for a in "xyz"], 1)
                if all(c in column for c in ("red", "green", "blue")):
                    most = 1.0 if {p[1]: p[0] for p in properties}["red"] in ("float", "float32", "double", "float64") else 255.0
                    colors = np.stack([column[c] for c in ("red", "green", "blue")], 1) / most
            continue
        for _ in range(n):  # rows with a list have no common size
            words = text[at].split() if text is not None else []
            at, w = (at + 1, 0) if text is not None else (at, 0)
            for p in properties:
                if p[0] != "list":
                    w += 1
                    at += 0 if text is not None else np.dtype(PLY_TYPES[p[0]]).itemsize
                    continue
                if text is not None:
                    values = np.array(words[w + 1 : w + 1 + int(words[w])], np.int64)
                    w += 1 + int(words[w])
                else:
                    count, item = np.dtype(order + PLY_TYPES[p[1]]), np.dtype(order + PLY_TYPES[p[2]])
                    size = int(np.frombuffer(body, count, 1, at)[0])
                    values = np.frombuffer(body, item, size, at + count.itemsize)
                    at += count.itemsize + size * item.itemsize
                if name == "face" and p[-1] in ("vertex_indices", "vertex_index"):
                    polygons.append(np.asarray(values).astype(np.int64))
    return points, _fans(polygons), colors


def _node_matrix(node: dict) -> np.ndarray:
    if "matrix" in node:
        return np.array(node["matrix"], float).reshape(4, 4).T
    x, y, z, w = node.get("rotation", (0, 0, 0, 1))
    turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = turn * np.array(node.get("scale", (1, 1, 1)), float), node.get("translation", (0, 0, 0))
    return m


def parse_glb(content: bytes) -> tuple[np.ndarray, np.ndarray, None]:
    """Vertices and triangles of all meshes of a GLB file's scene, moved by their nodes and put one after the other. Only
    triangle lists with their data in the file count; other primitives are skipped."""
    if content[:4] != b"glTF":
        raise ValueError("not a GLB file")
    chunks, at = {}, 12
    while at + 8 <= len(content):
        size, name = struct.unpack_from("<I4s", content, at)
        chunks.setdefault(name, content[at + 8 : at + 8 + size])
        at += 8 + size
    doc, data = json.loads(chunks[b"JSON"]), chunks.get(b"BIN\0", b"")

    def accessor(i: int) -> np.ndarray:
        a = doc["accessors"][i]
        view = doc["bufferViews"][a["bufferView"]]
        item, width = np.dtype("<" + GLTF_TYPES[a["componentType"]]), GLTF_SHAPES[a["type"]]
        start, step = view.get("byteOffset", 0) + a.get("byteOffset", 0), view.get("byteStride", item.itemsize * width)
        return np.ndarray((a["count"], width), item, data, start, (step, item.itemsize))

    points, faces, seen = [], [], 0
    roots = doc["scenes"][doc.get("scene", 0)].get("nodes", []) if doc.get("scenes") else range(len(doc.get("nodes", [])))
    todo = [(i, np.eye(4)) for i in roots]
    while todo:
        i, above = todo.pop(0)
        node = doc["nodes"][i]
        m = above @ _node_matrix(node)
        todo += [(k, m) for k in node.get("children", [])]
        for p in doc["meshes"][node["mesh"]]["primitives"] if "mesh" in node else []:
            if p.get("mode", 4) != 4 or "POSITION" not in p["attributes"]:
                continue
            own = accessor(p["attributes"]["POSITION"]).astype(float)
            ids = accessor(p["indices"]).astype(np.int64).ravel() if "indices" in p else np.arange(len(own))
            points.append(own @ m[:3, :3].T + m[:3, 3])
            faces.append(ids[: len(ids) // 3 * 3].reshape(-1, 3) + seen)
            seen += len(own)
    return np.concatenate([np.zeros((0, 3)), *points]), np.concatenate([np.zeros((0, 3), np.int64), *faces]), None


def parse_png(content: bytes) -> np.ndarray:
    """(height, width, channels) of a PNG file without interlacing, as numbers from 0 to 1; a palette's colours are put in."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, packed, palette = 8, [], None
    while at < len(content):
        size, name = struct.unpack_from(">I4s", content, at)
        part = content[at + 8 : at + 8 + size]
        at += 12 + size
        if name == b"IHDR":
            width, height, bits, kind, _, _, interlaced = struct.unpack(">IIBBBBB", part)
            if interlaced:
                raise ValueError("interlaced PNG files are not read")
        elif name == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            packed.append(part)
    n = PNG_CHANNELS[kind]
    line, step = (width * n * bits + 7) // 8, max(1, n * bits // 8)
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, line + 1)
    out = _unfiltered(raw[:, 0], raw[:, 1:].reshape(height, -1, step)).reshape(height, line)
    if bits == 16:
        values = out.reshape(height, -1, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)
    elif bits < 8:
        values = np.stack([out >> s & (1 << bits) - 1 for s in range(8 - bits, -1, -bits)], 2).reshape(height, -1)[:, : width * n]
    else:
        values = out
    values = values.reshape(height, width, n)
    return palette[values[:, :, 0]] / 255.0 if kind == 3 else values / float((1 << bits) - 1)


def _unfiltered(kinds: np.ndarray, differences: np.ndarray) -> np.ndarray:
    """Bytes (row, pixel, byte) from their differences to what each row's kind guesses from the bytes to the left, above, and left
    above. All three lie on earlier diagonals, so whole diagonals are done at once, whatever the kinds of their rows."""
    height, width, step = differences.shape
    out = np.zeros((height + 1, width + 1, step), np.int16)
    for d in range(height + width - 1):
        r = np.arange(max(0, d - width + 1), min(height, d + 1))
        k = d - r
        left, up, corner = out[r + 1, k], out[r, k + 1], out[r, k]
        slope = [np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)]
        nearest = np.where((slope[0] <= slope[1]) & (slope[0] <= slope[2]), left, np.where(slope[1] <= slope[2], up, corner))
        guess = np.choose(kinds[r][:, None], [np.zeros_like(left), left, up, (left + up) // 2, nearest])
        out[r + 1, k + 1] = (differences[r, k] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def _decoded(spark: SparkSession, path: str, decode: Callable[[str, bytes], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                yield from decode(name, content)

    send(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def _meshes(spark: SparkSession, path: str, parse: Callable) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of mesh files: each file is parsed once, into a written table of both, whose rows are then split."""

    def rows(name: str, content: bytes) -> Iterator[pa.RecordBatch]:
        p, f, c = parse(content)
        for table, width in ((p, 0), (f, 1)):
            for lo in range(0, len(table), ROWS):
                own = table[lo : lo + ROWS]
                none = lambda kind: [pa.nulls(len(own), kind)] * 3  # noqa: B023, E731
                at = none(pa.float64()) if width else [pa.array(np.ascontiguousarray(own[:, k])) for k in range(3)]
                colors = none(pa.float64()) if width or c is None else [pa.array(c[lo : lo + ROWS, k]) for k in range(3)]
                corners = [pa.array(np.ascontiguousarray(own[:, k])) for k in range(3)] if width else none(pa.int64())
                yield pa.record_batch([pa.array([name] * len(own)), pa.array([bool(width)] * len(own)), pa.array(np.arange(lo, lo + len(own))), *at, *colors, *corners], ["file", "is_face", "id", *"xyz", *"rgb", "v0", "v1", "v2"])

    both = kept(_decoded(spark, path, rows, "file string, is_face boolean, id long, x double, y double, z double, r double, g double, b double, v0 long, v1 long, v2 long"), "meshes")
    return both.where("not is_face").select("file", F.col("id").alias("vid"), *"xyz", *"rgb"), both.where("is_face").select("file", F.col("id").alias("face_id"), "v0", "v1", "v2")


def ply_meshes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices with colours (null without) and triangles of PLY files; polygons are cut into fans."""
    return _meshes(spark, path, parse_ply)


def glb_meshes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and triangles of GLB files, all meshes of a file's scene in one, moved by their nodes."""
    return _meshes(spark, path, parse_glb)


def png_images(spark: SparkSession, path: str) -> DataFrame:
    """file, row, col, r, g, b and a of PNG files, 0..1; grey goes to all three, a is 1 without transparency."""

    def pixels(name: str, content: bytes) -> Iterator[pa.RecordBatch]:
        image = parse_png(content)
        height, width, n = image.shape
        flat = image.reshape(-1, n)
        rgb = flat[:, :3] if n >= 3 else np.repeat(flat[:, :1], 3, 1)
        alpha = flat[:, -1] if n in (2, 4) else np.ones(len(flat))
        for lo in range(0, len(flat), ROWS):
            row, col = np.divmod(np.arange(lo, min(lo + ROWS, len(flat)), dtype=np.int32), width)
            yield pa.record_batch([pa.array([name] * len(row)), pa.array(row), pa.array(col), *[pa.array(np.ascontiguousarray(x[lo : lo + ROWS])) for x in (*rgb.T, alpha)]], ["file", "row", "col", *"rgba"])

    return _decoded(spark, path, pixels, "file string, row int, col int, r double, g double, b double, a double")


def png_masks(spark: SparkSession, path: str) -> DataFrame:
    """file, row, col and mask of PNG files: whether any colour is above 0."""
    return png_images(spark, path).select("file", "row", "col", (F.greatest("r", "g", "b") > 0).alias("mask"))


def meshes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (file, vid, x, y, z) and triangles of mesh files, by their suffix."""
    kind = path.rsplit(".", 1)[-1].lower()
    read = {"obj": obj_meshes, "ply": ply_meshes, "glb": glb_meshes}.get(kind)
    if read is None:
        raise ValueError(f"no reader for .{kind} meshes; obj, ply and glb are read")
    vertices, faces = read(spark, path)
    return vertices.select("file", "vid", *"xyz"), faces


def points(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z of point files by their suffix: arrays, meshes' vertices, else text."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("npy", "npz"):
        return array_points(spark, path).select(*"xyz")
    if kind in ("obj", "ply", "glb"):
        return meshes(spark, path)[0].select(*"xyz")
    return text_points(spark, path)


def normal_arrays(spark: SparkSession, path: str) -> DataFrame:
    """file, row, col, nx, ny, nz of (height, width, 3) .npy files, clamped to -1..1."""
    from .files import _arrays

    def pixels(name: str, content: bytes) -> Iterator[pa.RecordBatch]:
        a = _arrays(content).astype(np.float64)
        if a.ndim != 3 or a.shape[2] != 3:
            raise ValueError(f"{name}: a file of normals has three channels")
        row, col = np.divmod(np.arange(a.shape[0] * a.shape[1], dtype=np.int32), a.shape[1])
        yield pa.record_batch([pa.array([name] * len(row)), pa.array(row), pa.array(col), *[pa.array(np.clip(a[:, :, k].ravel(), -1, 1)) for k in range(3)]], ["file", "row", "col", "nx", "ny", "nz"])

    return _decoded(spark, path, pixels, "file string, row int, col int, nx double, ny double, nz double")


def png_normals(spark: SparkSession, path: str) -> DataFrame:
    """file, row, col, nx, ny, nz of PNG files whose colours are normals from -1..1 put into 0..1."""
    return png_images(spark, path).select("file", "row", "col", *[(2 * F.col(c) - 1).alias(n) for c, n in zip("rgb", ("nx", "ny", "nz"), strict=True)])
