"""Camera lists, rasters, visibility and files against known scenes and plain numpy."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallaxis.functions import camera as c
from parallaxis.functions import vector as v
from parallaxis.operators import generate, images, matching, meshes, normalize, raster, voxels
from parallaxis.plans.visible import mark_visible
from parallaxis.sources import colmap, files, geometry

CAMERA = "scene int, cam_idx int, width int, height int, fovx_deg double, fovy_deg double, cx double, cy double, w2c array<double>"


def pose(centre, target=(0, 0, 0), up=(0, 1, 0)):
    """w2c of a camera that looks at the target."""
    centre, target, up = (np.array(x, float) for x in (centre, target, up))
    z = (centre - target) / np.linalg.norm(centre - target)
    x = np.cross(up, z) / np.linalg.norm(np.cross(up, z))
    m = np.eye(4)
    m[:3, :3] = [x, np.cross(z, x), z]
    m[:3, 3] = -m[:3, :3] @ centre
    return m


def cameras(spark, poses, scene=0, size=(64, 48)):
    return spark.createDataFrame([(scene, i, *size, 60.0, None, size[0] / 2, size[1] / 2, m.ravel().tolist()) for i, m in enumerate(poses)], CAMERA)


def triangles(spark, *corners):
    return spark.createDataFrame([(i, *np.array(t, float).ravel().tolist()) for i, t in enumerate(corners)], "face_id long, " + ", ".join(f"{a}{m} double" for m in range(3) for a in "xyz"))


def test_floor_through_the_camera_is_cut_at_the_near_plane(spark):
    floor = triangles(spark, ((-50, -1, -50), (50, -1, -50), (-50, -1, 50)), ((50, -1, 50), (-50, -1, 50), (50, -1, -50)))
    cams = cameras(spark, [pose((0, 0, 3), (0, 0, 0))])
    got = {(r["row"], r["col"]): r["depth"] for r in raster.z_buffer(raster.fragments(floor, cams)).collect()}
    f = 32 / np.tan(np.radians(30))
    for row in range(48):
        for col in (0, 20, 63):
            down = (row + 0.5 - 24) / f  # of the ray's slope; the floor is one below the camera
            if down > 1 / 40:
                assert got[row, col] == pytest.approx(1 / down)
            elif row < 24:
                assert (row, col) not in got


def test_camera_inside_a_box_sees_all_around(spark):
    cell = voxels.grid(spark, 8)
    box = cell.where("i in (0, 7) or j in (0, 7) or k in (0, 7)")
    faces = voxels.boundary_triangles(box, 8)
    ways = [(1, 0, 0), (-1, 0, 0), (0, 0, 1), (0, 0, -1)]
    seen = raster.z_buffer(raster.fragments(faces, cameras(spark, [pose((0.01, 0.02, 0.03), w) for w in ways])))
    assert {r["cam_idx"]: r["count"] for r in seen.groupBy("cam_idx").count().collect()} == dict.fromkeys(range(4), 64 * 48)
    assert seen.agg(F.max("depth")).first()[0] < 0.5


def test_weights_are_of_the_whole_face_after_the_cut(spark):
    t = np.array([(-3, -1, -4), (5, -1, 9), (0, 2, -6)], float)
    cams = cameras(spark, [pose((0, 0, 3))])
    rows = raster.fragments(triangles(spark, t), cams).collect()
    f = 32 / np.tan(np.radians(30))
    assert len(rows) > 100
    for r in rows[::17]:
        at = (1 - r["b1"] - r["b2"]) * t[0] + r["b1"] * t[1] + r["b2"] * t[2]
        assert at == pytest.approx(((r["col"] + 0.5 - 32) / f * r["depth"], (24 - r["row"] - 0.5) / f * r["depth"], 3 - r["depth"]), abs=1e-9)


def test_large_triangles_in_blocks(spark):
    t = np.array([(-0.9, -0.7, -0.6), (0.8, 0.9, 0.1), (-0.2, 0.6, 0.9)])
    got = {(r["i"], r["j"], r["k"]) for r in voxels.voxelize_triangles(triangles(spark, t), 40).collect()}
    # points of the triangle, densely: each in a voxel that was found; and no found voxel far from its plane
    a, b = (x.ravel() for x in np.meshgrid(np.linspace(0, 1, 400), np.linspace(0, 1, 400)))
    inside = a + b <= 1
    p = t[0] + np.outer(a[inside], t[1] - t[0]) + np.outer(b[inside], t[2] - t[0])
    p = p[(np.abs(p) < 0.5).all(1)]
    assert {tuple(x) for x in np.minimum(np.floor((p + 0.5) * 40), 39).astype(int).tolist()} <= got
    n = np.cross(t[1] - t[0], t[2] - t[0])
    n /= np.linalg.norm(n)
    middle = (np.array(sorted(got)) + 0.5) / 40 - 0.5
    assert np.abs((middle - t[0]) @ n).max() <= np.abs(n).sum() / 80 + 1e-6


def rig(n=12, seed=0, spread=1.0):
    rng = np.random.default_rng(seed)
    return [pose(rng.normal(size=3) * spread + (0, 0, 4), rng.normal(size=3) * 0.1, (0.1, 0, 1.0)) for _ in range(n)]


def matrix_of(df):
    return np.array(df.first()["transform"]).reshape(4, 4)


@pytest.mark.parametrize("up", ["mean", "cluster", "plane"])
def test_frames_of_camera_lists(spark, up):
    poses = rig()
    m = matrix_of(normalize.axis_transform(cameras(spark, poses), up))
    assert m[:3, :3] @ m[:3, :3].T == pytest.approx(np.eye(3), abs=1e-7) and np.linalg.det(m[:3, :3]) > 0
    r = np.array([p[:3, :3] for p in poses])
    main = r[:, 1].sum(0) if up != "plane" else np.linalg.eigh(r[:, 0].T @ r[:, 0])[1][:, 0]
    if up == "cluster":
        near = r[:, 1] @ r[:, 1].T >= np.cos(np.radians(15))
        best = near.sum(1).argmax()
        if near.sum(1)[best] >= max(1, np.ceil(0.3 * len(poses))):
            main = r[near[best], 1].sum(0)
    main = main * np.sign(main @ r[:, 1].sum(0)) / np.linalg.norm(main)
    if up != "plane":
        assert m[:3, :3] @ main == pytest.approx((0, 0, 1), abs=1e-6)
    first = m[:3, :3] @ -r[0, 2]
    assert abs(first[1]) < 1e-6 and first[0] < 0, "the first view is level with minus x"
    o = np.array([-p[:3, :3].T @ p[:3, 3] for p in poses])
    d = r[:, 2]
    a = sum(np.eye(3) - np.outer(x, x) for x in d)
    focus = np.linalg.solve(a, sum((np.eye(3) - np.outer(x, x)) @ y for x, y in zip(d, o, strict=True)))
    assert m @ np.append(focus, 1) == pytest.approx((0, 0, 0, 1), abs=1e-6)


def test_transformed_cameras_see_the_same_picture(spark):
    poses = rig(5)
    s = normalize.join_similarity(normalize.rotation_between(np.array([1.0, 0, 0]), np.array([0, 0.6, 0.8])), 2.5, np.array([1.0, 2, 3]))
    t = spark.createDataFrame([(0, s.ravel().tolist())], "scene int, transform array<double>")
    moved = normalize.transform_cameras(cameras(spark, poses), t)
    p = np.array([0.3, -0.2, 0.1])
    q = (s @ np.append(p, 1))[:3]
    for before, after in ((cameras(spark, poses), moved),):
        a = {r["cam_idx"]: (r["u"], r["v"], r["depth"]) for r in c.project(before, v.lit3(*p)).collect()}
        b = {r["cam_idx"]: (r["u"], r["v"], r["depth"] / 2.5) for r in c.project(after, v.lit3(*q)).collect()}
        assert all(a[i] == pytest.approx(b[i], abs=1e-9) for i in range(5))


def test_rotation_between_opposite_and_equal_directions():
    for a, b in (((1.0, 0, 0), (-1.0, 0, 0)), ((0, 1.0, 0), (0, -1.0, 0)), ((0, 0, 1.0), (0, 0, 1.0)), ((0.6, 0.8, 0), (0, 0.8, 0.6))):
        r = normalize.rotation_between(np.array(a), np.array(b))
        assert r @ a == pytest.approx(b) and r @ r.T == pytest.approx(np.eye(3)) and np.linalg.det(r) == pytest.approx(1)


def test_spheres_of_round_and_of_one_sided_rigs(spark):
    rng = np.random.default_rng(3)
    ways = rng.normal(size=(30, 3))
    around = [pose(np.array((1, 2, 3)) + 4 * w / np.linalg.norm(w), (1, 2, 3)) for w in ways]
    flat = [pose((x, y, 5), (x, y, 0)) for x in (0, 1, 2) for y in (0, 2)] + [pose((1, 1, 5), (1, 1, 0))]
    both = cameras(spark, around).unionByName(cameras(spark, flat, 1))
    got = {r["scene"]: tuple(r)[1:] for r in normalize.cameras_sphere(both).collect()}
    assert got[0] == pytest.approx((1, 2, 3, 4), abs=1e-6)
    median = np.sqrt(2)
    assert got[1] == pytest.approx((1, 1, 5 - median, median), abs=1e-6)


def test_hull_centroids(spark):
    rng = np.random.default_rng(1)
    square = [(0, x, y) for x, y in [(0, 0), (4, 0), (4, 2), (0, 2), *(rng.random((200, 2)) * (4, 2))]]
    rows = square + [(1, 0.0, 0.0), (1, 2.0, 2.0), (1, 1.0, 1.0), (2, 5.0, 6.0), (2, 5.0, 6.0)]
    got = {r["scene"]: (r["x"], r["y"]) for r in normalize.hull_centroids(spark.createDataFrame([(a, float(x), float(y)) for a, x, y in rows], "scene int, x double, y double").repartition(3)).collect()}
    assert got[0] == pytest.approx((2, 1)) and got[1] == pytest.approx((1, 1)) and got[2] == (5, 6)


def test_lists_are_matched_and_judged(spark):
    poses = rig(10, seed=5, spread=2.0)
    order = [1, 0, 2, 3, 5, 4, 6, 7, 8, 9]
    s = normalize.join_similarity(normalize.rotation_between(np.array([1.0, 0, 0]), np.array([0.8, 0.6, 0])), 1.7, np.array([1.0, -2, 0.5]))
    ref = cameras(spark, poses).unionByName(cameras(spark, poses, 1)).unionByName(cameras(spark, poses, 2))
    mixed = [poses[i] for i in order]
    t = spark.createDataFrame([(i, np.linalg.inv(s).ravel().tolist()) for i in range(3)], "scene int, transform array<double>")
    cand = normalize.transform_cameras(cameras(spark, mixed), t).drop("scale")
    wrong = cameras(spark, rig(10, seed=9, spread=2.0), 1)
    fewer = cameras(spark, poses[:4], 2)
    matches, _ = matching.match_lists(cand, ref.where("scene = 0"))
    assert {(r["c_idx"], r["r_idx"]) for r in matches.collect()} == set(enumerate(order))
    verdicts = {r["scene"]: r for r in matching.upgrade_verdicts(cand.unionByName(wrong).unionByName(fewer), ref).collect()}
    assert [verdicts[i]["accepted"] for i in range(3)] == [True, False, False]
    assert verdicts[0]["place_p95"] < 1e-6 and verdicts[0]["turn_most"] < 1e-3 and verdicts[2]["place_p95"] is None


def test_samples_of_a_surface(spark):
    t = triangles(spark, ((0, 0, 0), (1, 0, 0), (0, 1, 0)), ((0, 0, 1), (3, 0, 1), (0, 3, 1)), ((0, 0, 2), (1, 0, 2), (2, 0, 2)))
    rows = meshes.sample_surface(t, 5000, 3).collect()
    share = sum(r["face_id"] == 0 for r in rows) / len(rows)
    assert abs(len(rows) - 5000) <= 2 and abs(share - 0.1) < 0.01 and not any(r["face_id"] == 2 for r in rows)
    assert all(r["x"] >= -1e-12 and r["y"] >= -1e-12 and r["x"] + r["y"] <= (1 if r["face_id"] == 0 else 3) + 1e-9 for r in rows)
    assert meshes.sample_count(0.0, 8) == 256 and meshes.sample_count(1.0, 8) == 512 and meshes.sample_count(1e9, 512) == 8_000_000


def test_merged_meshes_have_numbers_of_their_own(spark):
    one = spark.createDataFrame([(0, 1.0, 2.0, 3.0)], "vid long, x double, y double, z double")
    none = spark.createDataFrame([], "face_id long, v0 long, v1 long, v2 long")
    vertices, faces = meshes.merge([(one, none), (one, none), (one.limit(0), none), (one, none)])
    assert sorted(r["vid"] for r in vertices.collect()) == [0, 1, 2] and faces.count() == 0


def test_sampled_cameras(spark):
    got = generate.sample_cameras(spark, 40, 7, upper_share=1.0, fill=[(0.5, 0.6, 1.0), (0.8, 0.9, 3.0)])
    rows = got.withColumns({a: x for a, x in zip("xyz", c.position(), strict=True)}).collect()
    assert len({r["cam_idx"] for r in rows}) == 40 and all(np.linalg.norm((r["x"], r["y"], r["z"])) == pytest.approx(2.5) for r in rows)
    fill = [1 / (2.5 * np.tan(np.radians(r["fovx_deg"]) / 2)) for r in rows]
    assert all(0.5 <= x <= 0.6 + 1e-9 or 0.8 <= x <= 0.9 + 1e-9 for x in fill) and sum(x > 0.7 for x in fill) > 20
    ups = generate.random_ups(spark.range(50), 1).collect()
    assert all(np.linalg.norm(r["up"]) == pytest.approx(1) for r in ups)


def test_labels_with_masks_unknown_points_and_meshes(spark):
    cams = cameras(spark, [pose((0, 0, 3))], size=(128, 128))
    point = spark.createDataFrame([(0.03, 0.03, 0.03)], "x double, y double, z double")
    label = lambda df: {(r["i"], r["j"], r["k"]): r["label"] for r in df.collect()}
    plain = label(mark_visible(point, cams, 4))
    assert plain[2, 2, 2] == 1 and plain[2, 2, 3] <= 0 and plain[2, 2, 0] == 0 and plain[0, 0, 3] == 0
    off = spark.createDataFrame([(0, r, k, False) for r in range(4) for k in range(4)], "cam_idx int, row int, col int, mask boolean")
    blind = label(mark_visible(point, cams, 4, masks=off, size=(4, 4)))
    assert blind[2, 2, 2] == 0 and blind[0, 0, 3] < 0 and blind[2, 2, 0] < 0, "outside the mask rays are empty and nothing is shown"
    half = spark.createDataFrame([(0, r, k, k >= 2) for r in range(4) for k in range(4)], "cam_idx int, row int, col int, mask boolean")
    some = label(mark_visible(point, cams, 4, masks=half, size=(4, 4)))
    assert some[2, 2, 2] == 1 and some[0, 2, 2] < 0 and some[3, 0, 0] == 0
    kept = label(mark_visible(point, cams, 4, masks=half, size=(4, 4), unknown=spark.createDataFrame([(-0.4, 0.1, 0.1)], "x double, y double, z double")))
    assert kept[0, 2, 2] == 0 and {k: x for k, x in kept.items() if x == 1} == {k: x for k, x in some.items() if x == 1}
    wall = triangles(spark, ((-0.45, -0.45, 0), (0.45, -0.45, 0), (0, 0.45, 0)))
    assert label(mark_visible(None, cams, 4, triangles=wall))[2, 2, 2] == 1
    assert set(label(mark_visible(point.limit(0), cams, 4)).values()) == {0}
    with pytest.raises(ValueError):
        mark_visible(None, cams, 4)


def test_resizing_keeps_means_and_borders(spark):
    rows = [(0, r, k, float(r * 4 + k)) for r in range(3) for k in range(4)]
    px = spark.createDataFrame(rows, "cam_idx int, row int, col int, a double")
    big = {(r["row"], r["col"]): r["a"] for r in images.resize(px, 4, 3, 8, 6, ["a"]).collect()}
    assert len(big) == 48 and big[0, 0] == 0 and big[5, 7] == 11 and big[2, 2] == pytest.approx((0.75 * 1 + 0.25 * 0) * 4 + 0.75)
    same = {(r["row"], r["col"]): r["a"] for r in images.resize(px, 4, 3, 4, 3, ["a"]).collect()}
    assert same == {(r, k): a for _, r, k, a in rows}


def ply(kind):
    head = f"ply\nformat {kind} 1.0\ncomment x\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nelement face 2\nproperty list uchar int vertex_indices\nend_header\n".encode()
    points = [(0, 0, 0, 255, 0, 0), (1, 0, 0, 0, 255, 0), (1, 1, 0, 0, 0, 255), (0, 1, 0.5, 51, 51, 51)]
    faces = [(0, 1, 2, 3), (0, 1, 2)]
    if kind == "ascii":
        return head + "\n".join([" ".join(map(str, p)) for p in points] + [" ".join(map(str, (len(f), *f))) for f in faces]).encode() + b"\n"
    e = "<" if kind == "binary_little_endian" else ">"
    return head + b"".join(struct.pack(f"{e}fffBBB", *p) for p in points) + b"".join(struct.pack(f"{e}B{len(f)}i", len(f), *f) for f in faces)


@pytest.mark.parametrize("kind", ["ascii", "binary_little_endian", "binary_big_endian"])
def test_ply(spark, tmp_path, kind):
    (tmp_path / "a.ply").write_bytes(ply(kind))
    vertices, faces = geometry.ply_meshes(spark, str(tmp_path / "a.ply"))
    assert [tuple(r)[1:] for r in vertices.orderBy("vid").collect()][3] == (3, 0.0, 1.0, 0.5, 0.2, 0.2, 0.2)
    assert [tuple(r)[1:] for r in faces.orderBy("face_id").collect()] == [(0, 0, 1, 2), (1, 0, 2, 3), (2, 0, 1, 2)]
    assert geometry.points(spark, str(tmp_path / "a.ply")).count() == 4


def test_glb(spark, tmp_path):
    data = np.array([(0, 0, 0), (1, 0, 0), (0, 1, 0)], "<f4").tobytes() + np.array([0, 1, 2], "<u2").tobytes() + b"\0\0"
    doc = {
        "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"translation": [1, 2, 3], "children": [1], "mesh": 0}, {"rotation": [0, 0, 0.5**0.5, 0.5**0.5], "scale": [2, 2, 2], "mesh": 0}],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}]}],
        "accessors": [{"bufferView": 0, "componentType": 5126, "count": 3, "type": "VEC3"}, {"bufferView": 1, "componentType": 5123, "count": 3, "type": "SCALAR"}],
        "bufferViews": [{"buffer": 0, "byteOffset": 0, "byteLength": 36}, {"buffer": 0, "byteOffset": 36, "byteLength": 6}], "buffers": [{"byteLength": len(data)}],
    }
    js = json.dumps(doc).encode()
    js += b" " * (-len(js) % 4)
    body = struct.pack("<I4s", len(js), b"JSON") + js + struct.pack("<I4s", len(data), b"BIN\0") + data
    (tmp_path / "a.glb").write_bytes(b"glTF" + struct.pack("<II", 2, 12 + len(body)) + body)
    vertices, faces = geometry.meshes(spark, str(tmp_path / "a.glb"))
    at = np.array([tuple(r)[2:] for r in vertices.orderBy("vid").collect()])
    assert at == pytest.approx(np.array([(1, 2, 3), (2, 2, 3), (1, 3, 3), (1, 2, 3), (1, 4, 3), (-1, 2, 3)]), abs=1e-6)
    assert [tuple(r)[1:] for r in faces.orderBy("face_id").collect()] == [(0, 0, 1, 2), (1, 3, 4, 5)]


def png(image, kind, filters):
    h, w = image.shape[:2]
    step = 1 if image.ndim == 2 else image.shape[2]
    flat = image.reshape(h, -1).astype(int)
    lines, above = [], np.zeros(flat.shape[1], int)
    for r in range(h):
        left = np.concatenate((np.zeros(step, int), flat[r][:-step]))
        corner = np.concatenate((np.zeros(step, int), above[:-step]))
        p = left + above - corner
        d = np.stack([abs(p - left), abs(p - above), abs(p - corner)])
        paeth = np.choose(d.argmin(0), [left, above, corner])
        guess = [np.zeros_like(left), left, above, (left + above) // 2, paeth][filters[r % len(filters)]]
        lines.append(bytes([filters[r % len(filters)]]) + ((flat[r] - guess) % 256).astype(np.uint8).tobytes())
        above = flat[r]
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def test_png(spark, tmp_path):
    rng = np.random.default_rng(0)
    color, grey = rng.integers(0, 256, (11, 7, 3)), rng.integers(0, 2, (5, 6)) * 200
    (tmp_path / "c.png").write_bytes(png(color, 2, [0, 1, 2, 3, 4]))
    (tmp_path / "g.png").write_bytes(png(grey, 0, [4, 3]))
    got = {(r["row"], r["col"]): (r["r"], r["g"], r["b"]) for r in geometry.png_images(spark, str(tmp_path / "c.png")).collect()}
    assert len(got) == 77 and all(got[r, k] == pytest.approx(color[r, k] / 255) for r in range(11) for k in range(7))
    mask = {(r["row"], r["col"]): r["mask"] for r in geometry.png_masks(spark, str(tmp_path / "g.png")).collect()}
    assert mask == {(r, k): bool(grey[r, k]) for r in range(5) for k in range(6)}
    n = geometry.png_normals(spark, str(tmp_path / "c.png")).where("row = 2 and col = 3").first()
    assert n["nx"] == pytest.approx(2 * color[2, 3, 0] / 255 - 1)


def test_arrays_of_normals_and_files_by_suffix(spark, tmp_path):
    a = np.array([[[0.5, 2, -3], [0, 0, 1]]])
    np.save(tmp_path / "n.npy", a)
    assert [tuple(r)[3:] for r in geometry.normal_arrays(spark, str(tmp_path / "n.npy")).orderBy("col").collect()] == [(0.5, 1, -1), (0, 0, 1)]
    (tmp_path / "p.csv").write_text("1 2 3\n4 5 6\n")
    assert geometry.points(spark, str(tmp_path / "p.csv")).count() == 2
    with pytest.raises(ValueError):
        geometry.meshes(spark, "a.stl")
    (tmp_path / "m.obj").write_text("v 0 0 0\nv 1 0 zero\nv 0 1 0\nf 1 2 3\n")
    vertices, _ = files.obj_meshes(spark, str(tmp_path / "m.obj"))
    assert [r["z"] for r in vertices.orderBy("vid").collect()] == [0, None, 0]


def test_pose_folders_are_plain_files(spark, tmp_path):
    cams = cameras(spark, rig(3))
    colmap.write(cams, str(tmp_path))
    colmap.write(cams, str(tmp_path))
    assert (tmp_path / "cameras.txt").is_file() and (tmp_path / "images.txt").read_text().count("\n") >= 6
    back = colmap.read(spark, str(tmp_path)).collect()
    want = {f"{r['cam_idx'] + 1:06d}": r["w2c"] for r in cams.collect()}
    assert {r["image_name"]: pytest.approx(r["w2c"], abs=1e-9) for r in back} == want


def test_fields_of_view_are_checked(spark):
    cams = cameras(spark, rig(2))
    assert [r["fovx_deg"] for r in c.with_fov(cams, F.lit(70.0)).collect()] == [70, 70]
    for bad in (0.0, 180.0, -5.0):
        with pytest.raises(Exception, match="field of view"):
            c.with_fov(cams, F.lit(bad)).collect()
    two = c.with_intrinsics(cams, F.lit(50.0), F.lit(31.0), F.lit(23.0), fy_=F.lit(60.0)).select(c.fx(), c.fy(), "cx").first()
    assert tuple(two) == pytest.approx((50, 60, 31))
    assert c.with_intrinsics(cams, F.lit(50.0), F.lit(31.0), F.lit(23.0)).where("fovy_deg is null").count() == 2


def test_camera_files_round_trip(spark, tmp_path):
    from parallaxis.sources import poses

    cams = cameras(spark, rig(3)).drop("scene")
    same = lambda a, b: {r["cam_idx"]: pytest.approx(r["w2c"], abs=1e-9) for r in a.collect()} == {r["cam_idx"]: r["w2c"] for r in b.collect()}
    poses.write_records(cams, str(tmp_path / "r"))
    poses.write_records(cams.limit(0), str(tmp_path / "r"))
    assert same(poses.read_records(spark, str(tmp_path / "r")), cams)
    poses.write_records(cams.limit(1), str(tmp_path / "r"), overwrite=True)
    assert poses.read_records(spark, str(tmp_path / "r")).count() == 1
    poses.write_view_texts(cams, str(tmp_path / "t"))
    back = poses.read_view_texts(spark, str(tmp_path / "t" / "*"), 64, 48).withColumn("cam_idx", F.regexp_extract("file", r"name=(\d+)", 1).cast("int") - 1)
    assert same(back, cams) and back.first()["fovx_deg"] == pytest.approx(60)
    assert same(poses.from_stacked(poses.stacked(cams)), cams)
    named = cams.withColumn("image_id", F.when(F.col("cam_idx") > 0, "a"))
    with pytest.raises(ValueError, match="image_id"):
        poses.check_image_ids(named)
    poses.check_image_ids(named.where("cam_idx > 0"))


def test_light_of_an_even_environment(spark):
    from parallaxis.operators import lighting

    env = spark.createDataFrame([(r, k, 0.5, 1.0, 2.0) for r in range(32) for k in range(64)], "row int, col int, r double, g double, b double")
    sh = lighting.project_sh9(env, 64, 32)
    normals = spark.createDataFrame([(i, *map(float, n / np.linalg.norm(n))) for i, n in enumerate(np.random.default_rng(0).normal(size=(9, 3)))], "id int, nx double, ny double, nz double")
    for r in lighting.with_irradiance(normals, ("nx", "ny", "nz"), sh).collect():
        assert (r["er"], r["eg"], r["eb"]) == pytest.approx((0.5 * np.pi, np.pi, 2 * np.pi), rel=0.01)
    px = normals.select("id", "nx", "ny", "nz", *[F.col(f"n{a}").alias(f"v{a}") for a in "xyz"])
    level = (env, 64, 32)
    out = lighting.shade_environment(px, sh, [level, level], 0.5, 0.0)
    got = out.collect()
    assert len(got) == 9 and all(0 < r["r"] < r["g"] < r["b"] <= 1 for r in got) and max(r["g"] for r in got) - min(r["g"] for r in got) < 0.01
    pole = spark.createDataFrame([(0.0, 1.0, 0.0), (0.0, 0.0, -1.0), (1.0, 0.0, 0.0)], "x double, y double, z double")
    at = pole.select(*[e.alias(n) for e, n in zip(lighting.place_of(v.cols("x", "y", "z")), "uv", strict=True)]).collect()
    assert at[0]["v"] == pytest.approx(1) and tuple(at[1]) == pytest.approx((0.5, 0.5)) and at[2]["u"] == pytest.approx(0.75)
