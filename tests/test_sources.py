"""File sources and sinks by round trips and small files."""

import json
import struct

import numpy as np
import pytest

from parallaxis.sources import colmap, files, fixtures


def test_pose_folder_round_trip(spark, sf, tmp_path):
    cameras = fixtures.cameras(spark, sf, phase=0.3).where("cam_idx between 1 and 23")
    folder = f"file://{tmp_path}/views"
    colmap.write(cameras, folder)
    back = {r["image_id"]: r for r in colmap.read(spark, folder).collect()}
    for r in cameras.collect():
        got = back[r["cam_idx"] + 1]
        assert got["w2c"] == pytest.approx(r["w2c"], abs=1e-9) and got["image_name"] == f"{r['cam_idx'] + 1:06d}"
        assert (got["width"], got["height"], got["fovy_deg"]) == (128, 96, None) and got["fovx_deg"] == pytest.approx(60)
    assert len(back) == 23


def test_pose_records_are_told_from_point_lines(spark, tmp_path):
    record = "{} 1 0 0 0 0 0 0 {} {}.png"
    lines = ["# comment", "", record.format(1, 7, "b"), record.format(9, 7, "points line that looks like a record"), "short line", record.format(2, 8, "a"), "", record.format(3, 99, "c"), ""]
    (tmp_path / "images.txt").write_text("\n".join(lines))
    (tmp_path / "cameras.txt").write_text("# c\n7 PINHOLE 10 20 5 6 1 2\n8 SIMPLE_PINHOLE 10 20 5 1 2\n9 OPENCV 1 2 3 4 5 6 7 8\n7\n")
    got = colmap.read(spark, f"file://{tmp_path}").collect()
    assert [(r["image_id"], r["image_name"]) for r in got] == [(2, "a"), (1, "b")]
    assert got[0]["fovy_deg"] is None and got[1]["fovy_deg"] is not None


def test_point_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text("# x y z\n1 2 3 9\n\n4\t5  6\n7 8\n")
    assert sorted(map(tuple, files.text_points(spark, f"file://{tmp_path}/p.csv").collect())) == [(1, 2, 3), (4, 5, 6)]
    np.save(tmp_path / "a.npy", np.arange(8.0).reshape(2, 4))
    np.savez(tmp_path / "b.npz", n=np.arange(3), p=np.ones((1, 3), np.float32))
    got = [tuple(r)[1:] for r in files.array_points(spark, f"file://{tmp_path}/*.np[yz]").orderBy("file", "point_id").collect()]
    assert got == [(0, 0, 1, 2), (1, 4, 5, 6), (0, 1, 1, 1)]


def test_depth_files(spark, tmp_path):
    np.save(tmp_path / "d.npy", np.arange(6, dtype=np.float32).reshape(2, 3))
    np.save(tmp_path / "e.npy", np.stack([np.ones((1, 2)), np.full((1, 2), 0.25)], 2))
    got = [tuple(r)[1:] for r in files.depth_arrays(spark, f"file://{tmp_path}").orderBy("file", "row", "col").collect()]
    assert got == [(r, k, 3.0 * r + k, 1.0) for r in range(2) for k in range(3)] + [(0, 0, 1.0, 0.25), (0, 1, 1.0, 0.25)]


def test_mesh_text(spark, tmp_path):
    (tmp_path / "m.obj").write_text("# m\nv 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nvn 0 0 1\nf 1/1 2/2 3/3 4/4\nf -1 -2 -3\n")
    vertices, faces = files.obj_meshes(spark, f"file://{tmp_path}/m.obj")
    assert vertices.count() == 4
    assert sorted(tuple(r)[2:] for r in faces.collect()) == [(0, 1, 2), (0, 2, 3), (3, 2, 1)]


def glb(js: dict) -> bytes:
    body = json.dumps(js).encode()
    body += b" " * (-len(body) % 4)
    return struct.pack("<4sII", b"glTF", 2, 20 + len(body)) + struct.pack("<I4s", len(body), b"JSON") + body


def test_wrap_modes(spark, tmp_path):
    for name, js in (("a", {"samplers": [{"wrapS": 33648, "wrapT": 33071}]}), ("b", {"samplers": [{}]}), ("c", {})):
        (tmp_path / f"{name}.glb").write_bytes(glb(js))
    (tmp_path / "d.glb").write_bytes(b"no mesh")
    got = [tuple(r)[1:] for r in files.glb_wrap_modes(spark, f"file://{tmp_path}").orderBy("file").collect()]
    assert got == [("mirror", "clamp"), ("repeat", "repeat"), ("clamp", "clamp"), ("clamp", "clamp")]
