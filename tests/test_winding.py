"""Faces turned alike, against a plain search through the mesh."""

from collections import defaultdict, deque

import numpy as np

from parallaxis.operators import winding


def table(spark, faces):
    return spark.createDataFrame([(i, *map(int, f)) for i, f in faces], "face_id long, v0 long, v1 long, v2 long").repartition(3)


def by_search(faces):
    """flip of each face, from its part's face of the smallest id on, over edges that two faces share."""
    edges = defaultdict(list)
    for i, f in faces:
        for m in range(3):
            s, t = f[m], f[(m + 1) % 3]
            edges[min(s, t), max(s, t)].append((i, s < t))
    links = defaultdict(list)
    for own in edges.values():
        if len(own) == 2 and own[0][0] != own[1][0]:
            (a, x), (b, y) = own
            links[a].append((b, x == y)), links[b].append((a, x == y))
    out = {}
    for i, _ in sorted(faces):
        if i not in out:
            out[i], queue = (i, False), deque([i])
            while queue:
                a = queue.popleft()
                for b, odd in links[a]:
                    if b not in out:
                        out[b] = (i, out[a][1] ^ odd)
                        queue.append(b)
    return out


def sphere(n, first, vertex):
    """A band of triangles around a cylinder, closed: all turn outwards."""
    ring = lambda k, up: vertex + 2 * (k % n) + up
    return [x for k in range(n) for x in ((first + 2 * k, (ring(k, 0), ring(k + 1, 0), ring(k, 1))), (first + 2 * k + 1, (ring(k, 1), ring(k + 1, 0), ring(k + 1, 1))))]


def test_parts_and_flips(spark):
    draw = np.random.default_rng(1)
    faces = [*sphere(40, 1000, 0), *sphere(7, 500, 5000), (3, (9000, 9001, 9002)), (4, (9100, 9101, 9102)), (5, (9101, 9100, 9103)), (6, (9100, 9101, 9104))]
    mixed = [(i, (f[0], f[2], f[1]) if draw.random() < 0.5 else f) for i, f in faces]
    mixed = [mixed[k] for k in draw.permutation(len(mixed))]
    turned, conflicts = winding.orientation(table(spark, mixed))
    assert {r["face_id"]: (r["part"], r["flip"]) for r in turned.collect()} == by_search(mixed)
    assert conflicts.count() == 0, "an edge of three faces ties none of them"
    again, none = winding.orientation(winding.wound(table(spark, mixed))[0])
    assert again.where("flip").count() == 0 and none.count() == 0


def test_one_sided_band_is_reported(spark):
    n = 9
    at = lambda k, up: 2 * (k % n) + (up ^ (k // n))
    faces = [x for k in range(n) for x in ((2 * k, (at(k, 0), at(k + 1, 0), at(k, 1))), (2 * k + 1, (at(k, 1), at(k + 1, 0), at(k + 1, 1))))]
    turned, conflicts = winding.orientation(table(spark, faces))
    assert [(r["part"], r["conflicts"] > 0) for r in conflicts.collect()] == [(0, True)]
    assert turned.count() == 2 * n and turned.select("part").distinct().count() == 1


def test_post_processing_keeps_what_belongs_to_vertices_and_corners(spark):
    nan, inf = float("nan"), float("inf")
    vertices = spark.createDataFrame([(10, 0.0, 0.0, 0.0, "a", 0.1), (11, 1.0, 0.0, 0.0, "b", nan), (12, 0.0, 1.0, 0.0, "c", inf), (13, 1.0, 1.0, 0.0, "d", -inf), (14, nan, 0.0, 0.0, "e", 0.5), (15, 5.0, 5.0, 5.0, "f", 0.6)], "vid long, x double, y double, z double, name string, tu double")
    faces = table(spark, [(1, (10, 11, 12)), (2, (12, 11, 13)), (3, (10, 11, 14)), (4, (11, 12, 13)), (5, (10, 10, 12))])
    faces = faces.where("face_id <> 4").unionByName(table(spark, [(7, (10, 12, 13))])).where("face_id <> 7")
    flipped = faces.selectExpr("face_id", "v0", "if(face_id = 2, v2, v1) as v1", "if(face_id = 2, v1, v2) as v2")
    values = spark.createDataFrame([(f, k, float(10 * f + k), nan if k else 0.5) for f in (1, 2, 3) for k in range(3)], "face_id long, corner int, shade double, tv double")
    v, f, c = winding.post_process(vertices, flipped, values)
    names = {r["vid"]: r["name"] for r in v.collect()}
    assert sorted(names) == [0, 1, 2, 3] and sorted(names.values()) == ["a", "b", "c", "d"]
    assert {r["name"]: r["tu"] for r in v.collect()} == {"a": 0.1, "b": 0.0, "c": 1.0, "d": 0.0}
    assert {tuple(round(r[n]) for n in ("nx", "ny", "nz")) for r in v.collect()} == {(0, 0, 1)}
    assert {r["face_id"]: "".join(names[r[f"v{m}"]] for m in range(3)) for r in f.collect()} == {1: "abc", 2: "cbd"}
    assert {(r["face_id"], r["corner"]): (r["shade"], r["tv"]) for r in c.collect()} == {(1, 0): (10, 0.5), (1, 1): (11, 0), (1, 2): (12, 0), (2, 0): (20, 0.5), (2, 1): (22, 0), (2, 2): (21, 0)}
    lone = winding.post_process(vertices, spark.createDataFrame([(1, 10, 11, 12), (2, 10, 12, 11)], "face_id long, v0 long, v1 long, v2 long"), fix_winding=False)[0]
    assert all(abs(r["nx"] ** 2 + r["ny"] ** 2 + r["nz"] ** 2 - 1) < 1e-9 for r in lone.collect()), "normals that cancel out are replaced"
