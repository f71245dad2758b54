"""The registered queries in SQL over the same tables."""

from __future__ import annotations

from itertools import product
from math import atan2, pi, sqrt

W, H, FOV = 128, 96, 60.0
FX = f"({W} / (2 * tan(radians({FOV}) / 2)))"
AXES = "xyz"


def points(scale: str = "1.0", name: str = "pts") -> str:
    return f"{name} AS (SELECT vec_id AS point_id, " + ", ".join(f"embedding[{i + 1}]::DOUBLE * {scale}::DOUBLE AS {a}" for i, a in enumerate(AXES)) + " FROM embeddings)"


def cameras(radius: str = "2.5", phase: str = "0.0", name: str = "cams") -> str:
    return f"""{name}_a AS (SELECT n_nationkey::INT AS cam_idx, acos(greatest(-1.0, least(1.0, 1 - 2 * n_nationkey / 24.0::DOUBLE))) AS phi, n_nationkey * 2.399963229728653::DOUBLE + {phase}::DOUBLE AS theta FROM nation),
{name}_b AS (SELECT cam_idx, sin(phi) AS sp, cos(phi) AS cp, sin(theta) AS st, cos(theta) AS ct FROM {name}_a),
{name}_c AS (SELECT cam_idx, -ct AS r00, st AS r01, 0.0::DOUBLE AS r02, -cp * st AS r10, -cp * ct AS r11, sp AS r12, sp * st AS r20, sp * ct AS r21, cp AS r22, sp * st * {radius}::DOUBLE AS px, sp * ct * {radius}::DOUBLE AS py, cp * {radius}::DOUBLE AS pz FROM {name}_b),
{name} AS (SELECT *, -(r00 * px + r01 * py + r02 * pz) AS t0, -(r10 * px + r11 * py + r12 * pz) AS t1, -(r20 * px + r21 * py + r22 * pz) AS t2 FROM {name}_c)"""


PROJECTED = f"""cam_points AS (SELECT cam_idx, point_id, r00 * x + r01 * y + r02 * z + t0 AS a, r10 * x + r11 * y + r12 * z + t1 AS b, r20 * x + r21 * y + r22 * z + t2 AS d FROM pts, cams),
proj AS (SELECT cam_idx, point_id, -d AS depth, CASE WHEN d < -1e-6 THEN ({FX} * a / -d + {W / 2} + 0.5) / {W} END AS u, CASE WHEN d < -1e-6 THEN ({FX} * b / -d + {H / 2} + 0.5) / {H} END AS v FROM cam_points)"""

TRIANGLES = "tris AS (SELECT vec_id AS face_id, " + ", ".join(f"embedding[{3 * m + k + 1}]::DOUBLE AS {a}{m}" for m in range(3) for k, a in enumerate(AXES)) + " FROM embeddings)"
PIXELS = """pix AS (SELECT floor(event_id / 1000)::INT AS cam_idx, floor((event_id % 1000) / 40)::INT AS "row", (event_id % 40)::INT AS col, 1 + value / 200 AS depth, value AS conf, event_type <> 'error' AS mask FROM events)"""
EDGES = "x1 - x0 AS ax, y1 - y0 AS ay, z1 - z0 AS az, x2 - x0 AS bx, y2 - y0 AS by_, z2 - z0 AS bz"
CROSS = "ay * bz - az * by_ AS cx, az * bx - ax * bz AS cy, ax * by_ - ay * bx AS cz"


def r6(e: str, name: str) -> str:
    return f"round({e}, 6) + 0.0 AS {name}"


def voxels(source: str, r: int, name: str = "vox") -> str:
    at = lambda a, n: f"greatest(0, least({r - 1}, floor(({a} + 0.5) * {r})))::INT AS {n}"
    return f"{name} AS (SELECT DISTINCT {at('x', 'i')}, {at('y', 'j')}, {at('z', 'k')} FROM {source} WHERE abs(x) <= 0.5 AND abs(y) <= 0.5 AND abs(z) <= 0.5)"


def grid(r: int, name: str = "cells") -> str:
    return f"{name} AS (SELECT (id // {r * r})::INT AS i, (id // {r} % {r})::INT AS j, (id % {r})::INT AS k FROM range({r**3}) t(id))"




def _ring(axis: int, ahead: int) -> list[tuple[int, ...]]:
    """Corners of the unit cube on one of its sides, by their angle around the side's middle; seen from outside, against the clock."""
    u, w = (axis + 1) % 3, (axis + 2) % 3
    own = [c for c in product((0, 1), repeat=3) if c[axis] == ahead]
    return sorted(own, key=lambda c: atan2(c[w] - 0.5, c[u] - 0.5) if ahead else atan2(c[u] - 0.5, c[w] - 0.5))


FACE_ROWS = [(tuple((2 * ahead - 1) * (a == axis) for a in range(3)), _ring(axis, ahead)) for axis in range(3) for ahead in (1, 0)]
SIDES = "sides(face, di, dj, dk) AS (VALUES " + ", ".join(f"({n}, {d[0]}, {d[1]}, {d[2]})" for n, (d, _) in enumerate(FACE_ROWS)) + ")"
EXPOSED = "exposed AS (SELECT v.i, v.j, v.k, s.face FROM vox v, sides s WHERE NOT EXISTS (SELECT 1 FROM vox o WHERE o.i = v.i + s.di AND o.j = v.j + s.dj AND o.k = v.k + s.dk))"
HALVES = "halves(face, half, " + ", ".join(f"{a}{m}" for m in range(3) for a in "abc") + ") AS (VALUES " + ", ".join(
    f"({n}, {h}, " + ", ".join(f"{float(x)}" for m in t for x in ring[m]) + ")" for n, (_, ring) in enumerate(FACE_ROWS) for h, t in enumerate(((0, 1, 2), (0, 2, 3)))
) + ")"
BOUNDARY = "bound AS (SELECT ((i::BIGINT * 8 + j) * 8 + k) * 12 + face * 2 + half AS face_id, i, j, k, " + ", ".join(f"({n} + {c}{m}) / 8.0::DOUBLE - 0.5 AS {a}{m}" for m in range(3) for n, c, a in zip("ijk", "abc", AXES, strict=True)) + " FROM exposed JOIN halves USING (face))"


def overlap(half: float) -> str:
    eps = half * 1e-5
    t = [[f"p{a}{m}" for a in AXES] for m in range(3)]
    tests = []
    for a in AXES:
        p = ", ".join(f"p{a}{m}" for m in range(3))
        tests += [f"least({p}) <= {half + eps}::DOUBLE", f"greatest({p}) >= {-half - eps}::DOUBLE"]
    tests.append(f"abs(nx * px0 + ny * py0 + nz * pz0) <= {half}::DOUBLE * (abs(nx) + abs(ny) + abs(nz)) + {eps}::DOUBLE")
    for a in range(3):
        b, c = AXES[(a + 1) % 3], AXES[(a + 2) % 3]
        for e in ("e", "f", "g"):
            p = ", ".join(f"p{b}{m} * {e}{c} - p{c}{m} * {e}{b}" for m in range(3))
            reach = f"({half}::DOUBLE * (abs({e}{c}) + abs({e}{b})) + {eps}::DOUBLE)"
            tests += [f"least({p}) <= {reach}", f"greatest({p}) >= -{reach}"]
    del t
    return " AND ".join(tests)


def nearest(polar: bool) -> str:
    p = [("r20", "r21", "r22"), ("px", "py", "pz")][not polar]
    d = " + ".join(f"(t.{q} - s.{q}) * (t.{q} - s.{q})" for q in p)
    return f"WITH {cameras()}, {cameras('2.7', '0.21', 'alt')}, d AS (SELECT t.cam_idx, s.cam_idx AS source_idx, row_number() OVER (PARTITION BY t.cam_idx ORDER BY round({d}, 12), s.cam_idx) AS n FROM alt t, cams s) SELECT cam_idx, source_idx FROM d WHERE n = 1"


def angle(*pairs: tuple[str, str]) -> str:
    return "degrees(acos(greatest(-1.0, least(1.0, " + " + ".join(f"{a} * {b}" for a, b in pairs) + "))))"


def inner_matrix() -> str:
    near, far = 0.01, 100.0
    proj = [[f"2 * {FX} / {W}", "0.0", "0.0", "0.0"], ["0.0", f"-(2 * {FX} / {H})", "0.0", "0.0"], ["0.0", "0.0", f"{(far + near) / (near - far)}::DOUBLE", f"{2 * far * near / (near - far)}::DOUBLE"], ["0.0", "0.0", "-1.0", "0.0"]]
    m = [[f"r{i}{j}" for j in range(3)] + [f"t{i}"] for i in range(3)] + [["0.0", "0.0", "0.0", "1.0"]]
    return ", ".join(r6(" + ".join(f"({proj[i][k]}) * ({m[k][j]})" for k in range(4)), f"m{i}{j}") for i in range(4) for j in range(4))


def signed(signs: tuple[int, ...], name: str) -> str:
    m = [f"r{i}{j}" if j < 3 else f"t{i}" for i in range(3) for j in range(4)]
    return ", ".join(r6(f"{s} * {e}", f"{name}{k // 4}{k % 4}") for k, (s, e) in enumerate(zip(signs, m, strict=False)))


def look_at() -> str:
    return f"""WITH {points('10.0')}, a AS (SELECT *, sqrt(x * x + y * y + z * z) + 1e-8 AS n FROM pts), f AS (SELECT *, -x / n AS fx, -y / n AS fy, -z / n AS fz, 1.0::DOUBLE / (1.0::DOUBLE + 1e-8) AS w FROM a),
b AS (SELECT *, fy * w AS ax, -fx * w AS ay, 0.0::DOUBLE AS az FROM f), c AS (SELECT *, sqrt(ax * ax + ay * ay) + 1e-8 AS m FROM b), d AS (SELECT *, ax / m AS r00, ay / m AS r01, az / m AS r02, -fx AS r20, -fy AS r21, -fz AS r22 FROM c),
e AS (SELECT *, r21 * r02 - r22 * r01 AS yx, r22 * r00 - r20 * r02 AS yy, r20 * r01 - r21 * r00 AS yz FROM d), g AS (SELECT *, sqrt(yx * yx + yy * yy + yz * yz) + 1e-8 AS q FROM e), h AS (SELECT *, yx / q AS r10, yy / q AS r11, yz / q AS r12 FROM g)
SELECT point_id, {", ".join(r6(f"r{i}{j}", f"r{i}{j}") for i in range(3) for j in range(3))}, {", ".join(r6(f"-(r{i}0 * x + r{i}1 * y + r{i}2 * z)", f"t{a}") for i, a in enumerate(AXES))} FROM h"""


def distances(r: int, mask: str) -> str:
    return f"near AS (SELECT c.i, c.j, c.k, coalesce(min(abs(c.i - m.i) + abs(c.j - m.j) + abs(c.k - m.k)), {3 * r})::INT AS distance FROM cells c LEFT JOIN {mask} m ON TRUE GROUP BY ALL)"


SCREEN = f"""corner AS (SELECT cam_idx, face_id, {", ".join(f"r00 * x{m} + r01 * y{m} + r02 * z{m} + t0 AS a{m}, r10 * x{m} + r11 * y{m} + r12 * z{m} + t1 AS b{m}, -(r20 * x{m} + r21 * y{m} + r22 * z{m} + t2) AS w{m}" for m in range(3))} FROM tris, cams),
screen AS (SELECT cam_idx, face_id, {", ".join(f"w{m}, {FX} * a{m} / w{m} + {W / 2} AS px{m}, {H} - ({FX} * b{m} / w{m} + {H / 2}) AS py{m}" for m in range(3))} FROM corner WHERE w0 > 1e-6 AND w1 > 1e-6 AND w2 > 1e-6),
span AS (SELECT *, greatest(0, ceil(least(px0, px1, px2) - 0.5))::INT AS c0, least({W - 1}, floor(greatest(px0, px1, px2) - 0.5))::INT AS c1, greatest(0, ceil(least(py0, py1, py2) - 0.5))::INT AS q0, least({H - 1}, floor(greatest(py0, py1, py2) - 0.5))::INT AS q1 FROM screen),
cell AS (SELECT *, r.r + 0.5 AS y, c.c + 0.5 AS x FROM span, range({H}) r(r), range({W}) c(c) WHERE r.r BETWEEN q0 AND q1 AND c.c BETWEEN c0 AND c1),
edges AS (SELECT cam_idx, face_id, r, c, w0, w1, w2, (px2 - px1) * (y - py1) - (py2 - py1) * (x - px1) AS e0, (px0 - px2) * (y - py2) - (py0 - py2) * (x - px2) AS e1, (px1 - px0) * (y - py0) - (py1 - py0) * (x - px0) AS e2 FROM cell),
frag AS (SELECT cam_idx, face_id, r, c, 1 / ((e0 / w0 + e1 / w1 + e2 / w2) / (e0 + e1 + e2)) AS depth FROM edges WHERE e0 + e1 + e2 <> 0 AND e0 * (e0 + e1 + e2) >= 0 AND e1 * (e0 + e1 + e2) >= 0 AND e2 * (e0 + e1 + e2) >= 0),
best AS (SELECT *, row_number() OVER (PARTITION BY cam_idx, r, c ORDER BY depth, face_id) AS n FROM frag)"""

FIB = f"fib AS (SELECT id AS idx, acos(greatest(-1.0, least(1.0, 1 - 2 * id / ((SELECT count(*) FROM embeddings) - 1)::DOUBLE))) AS phi, id * {pi * (3 - sqrt(5))}::DOUBLE AS theta FROM range((SELECT count(*) FROM embeddings)) t(id))"
MOMENT = f"{points()}, pair AS (SELECT point_id % 3 AS scene, x, y, z, 2 * y + 0.5 AS tx, -2 * x + 0.25 AS ty, 2 * z - 1 AS tz FROM pts)"
CAMS, PTS = cameras(), points()

SQL: dict[str, str] = {
    "camera_intrinsics": f"SELECT n_nationkey::INT AS cam_idx, {r6(FX, 'fx')}, {r6(FX, 'fy')}, {r6(f'degrees(2 * atan(tan(radians({FOV}) / 2) * {H} / {W}))', 'fovy')}, {r6(f'degrees(2 * atan({W} / (2 * {FX})))', 'fovx')} FROM nation",
    "camera_pose_parts": f"WITH {CAMS} SELECT cam_idx, {', '.join(r6(f'p{a}', f'p{a}') for a in AXES)}, {', '.join(r6(f'-r2{i}', f'f{a}') for i, a in enumerate(AXES))}, {', '.join(r6(f'r1{i}', f'u{a}') for i, a in enumerate(AXES))} FROM cams",
    "camera_to_world": f"WITH {CAMS} SELECT cam_idx, {', '.join(r6(f'r{j}{i}' if j < 3 else f'p{AXES[i]}', f'm{i}{j}') for i in range(3) for j in range(4))} FROM cams",
    "camera_flipped_frames": f"WITH {CAMS} SELECT cam_idx, {signed((1, -1, -1, 1, -1, 1, 1, -1, -1, 1, 1, -1), 'a')}, {signed((1, 1, 1, 1, -1, -1, -1, -1, -1, -1, -1, -1), 'b')} FROM cams",
    "camera_polar_angles": f"WITH {CAMS} SELECT cam_idx, {r6('acos(greatest(-1.0, least(1.0, r22)))', 'phi')}, {r6('CASE WHEN r20 * r20 + r21 * r21 < 1e-24 THEN 0.0 ELSE atan2(r20, r21) END', 'theta')} FROM cams",
    # of a rotation m: 4xx = 1 + m00 - m11 - m22, 4wx = m21 - m12, and so on
    "camera_quaternions": f"WITH {cameras('2.5', '0.3')}, f AS (SELECT cam_idx, r00 AS a, r01 AS b, r02 AS c, -r10 AS d, -r11 AS e, -r12 AS f, -r20 AS g, -r21 AS h, -r22 AS i, t0, -t1 AS t1, -t2 AS t2 FROM cams) SELECT cam_idx, {r6('(1 + a - e - i) / 4', 'xx')}, {r6('(1 - a + e - i) / 4', 'yy')}, {r6('(1 - a - e + i) / 4', 'zz')}, {r6('(h - f) / 4', 'wx')}, {r6('(c - g) / 4', 'wy')}, {r6('(d - b) / 4', 'wz')}, {r6('t0', 'tx')}, {r6('t1', 'ty')}, {r6('t2', 'tz')} FROM f",
    "camera_clip_matrix": f"WITH {CAMS} SELECT cam_idx, {inner_matrix()} FROM cams",
    "look_at_poses": look_at(),
    "project_points": f"WITH {PTS}, {CAMS}, {PROJECTED} SELECT cam_idx, point_id, {r6('u', 'u')}, {r6('v', 'v')}, {r6('depth', 'depth')} FROM proj",
    "points_in_frame": f"WITH {points('6.0')}, {CAMS}, {PROJECTED} SELECT cam_idx, count(*) FILTER (u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1) AS framed, count(*) FILTER (u IS NULL) AS behind FROM proj GROUP BY cam_idx",
    "camera_depth_range": f"WITH {PTS}, {CAMS}, {PROJECTED}, f AS (SELECT cam_idx, greatest(0.5 * min(depth), 1e-4) AS n, max(depth) AS m FROM proj WHERE depth > 0 GROUP BY cam_idx) SELECT cam_idx, {r6('n', 'near')}, {r6('greatest(2 * m, 10 * n)', 'far')} FROM f",
    "depth_to_world": f"""WITH {CAMS}, {PIXELS}, s AS (SELECT *, (((col + 0.5) / 40.0::DOUBLE) * {W} - 0.5 - {W / 2}) * depth / {FX} - t0 AS a, ((1 - ("row" + 0.5) / 25.0::DOUBLE) * {H} - 0.5 - {H / 2}) * depth / {FX} - t1 AS b, -depth - t2 AS d FROM pix JOIN cams USING (cam_idx)) SELECT cam_idx, "row", col, {", ".join(r6(f"r0{i} * a + r1{i} * b + r2{i} * d", a) for i, a in enumerate(AXES))} FROM s""",
    "depth_confidence_quantile": f"WITH {PIXELS}, o AS (SELECT cam_idx, conf, row_number() OVER (PARTITION BY cam_idx ORDER BY conf) AS r, count(*) OVER (PARTITION BY cam_idx) AS n FROM pix) SELECT cam_idx, conf AS least FROM o WHERE r = floor(0.34 * (n - 1)) + 1",
    "depth_mask_pixels": f"""WITH {PIXELS}, o AS (SELECT cam_idx, conf, row_number() OVER (PARTITION BY cam_idx ORDER BY conf) AS r, count(*) OVER (PARTITION BY cam_idx) AS n FROM pix), q AS (SELECT cam_idx, conf AS least FROM o WHERE r = floor(0.8 * (n - 1)) + 1) SELECT cam_idx, "row", col, depth, conf FROM pix JOIN q USING (cam_idx) WHERE mask AND depth > 1e-5 AND depth < 1e5 AND conf >= least""",
    "depth_visualised": f"WITH {PIXELS}, m AS (SELECT cam_idx, min(depth) AS lo, max(depth) AS hi FROM pix GROUP BY cam_idx), s AS (SELECT cam_idx, greatest(0.0, least(1.0, (depth - lo) / (hi - lo + 1e-8))) AS shade FROM pix JOIN m USING (cam_idx)) SELECT cam_idx, {r6('avg(shade)', 'mean')}, {r6('max(shade)', 'top')}, sum(floor(greatest(0.0, least(255.0, round(shade, 9) * 255)))::INT)::BIGINT AS bytes FROM s GROUP BY cam_idx",
    "mask_eroded": f"""WITH {PIXELS} SELECT p.cam_idx, p."row", p.col FROM pix p JOIN pix q ON p.cam_idx = q.cam_idx AND abs(p."row" - q."row") <= 1 AND abs(p.col - q.col) <= 1 AND q.mask GROUP BY ALL HAVING count(*) = 9""",
    "mask_crop_box": f"""WITH {PIXELS}, m AS (SELECT cam_idx, "row" AS r, col AS c, mask AND "row" BETWEEN 5 AND 15 AND col BETWEEN 8 AND 30 AS m FROM pix) SELECT cam_idx, coalesce(greatest(0, min(r) FILTER (m) - 2), 0)::INT AS row0, coalesce(least(24, max(r) FILTER (m) + 2), 24)::INT AS row1, coalesce(greatest(0, min(c) FILTER (m) - 2), 0)::INT AS col0, coalesce(least(39, max(c) FILTER (m) + 2), 39)::INT AS col1 FROM m GROUP BY cam_idx""",
    "masked_crop": f"""WITH {PIXELS}, b AS (SELECT cam_idx, coalesce(greatest(0, min("row") FILTER (conf > 450) - 1), 0) AS r0, coalesce(least(24, max("row") FILTER (conf > 450) + 1), 24) AS r1, coalesce(greatest(0, min(col) FILTER (conf > 450) - 1), 0) AS c0, coalesce(least(39, max(col) FILTER (conf > 450) + 1), 39) AS c1 FROM pix GROUP BY cam_idx) SELECT cam_idx, ("row" - r0)::INT AS "row", (col - c0)::INT AS col, conf FROM pix JOIN b USING (cam_idx) WHERE "row" BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1""",
    "nearest_samples": f"WITH {PTS}, {CAMS}, {PROJECTED}, s AS (SELECT cam_idx, point_id, round(u, 9) AS u, 1 - round(v, 9) AS w FROM proj WHERE u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1) SELECT cam_idx, point_id, greatest(0, least(39, round_even(u * 40 - 0.5, 0)))::INT AS a, greatest(0, least(24, round_even(w * 25 - 0.5, 0)))::INT AS b, greatest(0, least(39, trunc(u * 40)))::INT AS p, greatest(0, least(24, trunc(w * 25)))::INT AS q FROM s",
    "letterbox_places": "WITH a AS (SELECT n_nationkey, 100 + 7 * n_nationkey AS w, 60 + 11 * n_nationkey AS h FROM nation), b AS (SELECT *, least(128.0::DOUBLE / w, 96.0::DOUBLE / h) AS s FROM a), c AS (SELECT n_nationkey, greatest(1, least(128, round_even(w * s, 0)))::INT AS w, greatest(1, least(96, round_even(h * s, 0)))::INT AS h FROM b) SELECT n_nationkey, ((128 - w) // 2)::INT AS x1, ((96 - h) // 2)::INT AS y1, ((128 - w) // 2 + w)::INT AS x2, ((96 - h) // 2 + h)::INT AS y2, w, h FROM c",
    "nearest_cameras": nearest(False),
    "polar_nearest_cameras": nearest(True),
    "camera_match_cost": f"WITH {CAMS}, {cameras('2.7', '0.21', 'alt')}, p AS (SELECT c.cam_idx AS c_idx, r.cam_idx AS r_idx, sqrt((c.px - r.px) * (c.px - r.px) + (c.py - r.py) * (c.py - r.py) + (c.pz - r.pz) * (c.pz - r.pz)) AS d, greatest({angle(*[(f'c.r2{i}', f'r.r2{i}') for i in range(3)])}, {angle(*[(f'c.r1{i}', f'r.r1{i}') for i in range(3)])}) AS g FROM alt c, cams r) SELECT c_idx, r_idx, {r6('d / 2.5 / 0.15 + g / 15.0', 'cost')}, round(g, 4) AS angle FROM p",
    "view_spread": f"WITH {CAMS} SELECT round(coalesce(max({angle(*[(f'a.r2{i}', f'b.r2{i}') for i in range(3)])}), 0.0), 4) AS angle FROM cams a JOIN cams b ON a.cam_idx < b.cam_idx",
    "trajectory_radius": f"WITH {CAMS}, m AS (SELECT avg(px) AS mx, avg(py) AS my, avg(pz) AS mz FROM cams) SELECT {r6('median(sqrt((px - mx) * (px - mx) + (py - my) * (py - my) + (pz - mz) * (pz - mz)))', 'radius')} FROM cams, m",
    "voxel_counts": "WITH d AS (SELECT (l_quantity - 25.5) / 49.0 AS x, (l_extendedprice - 52500.0) / 105000.0 AS y, l_discount / 0.1::DOUBLE - 0.5 AS z FROM lineitem) SELECT greatest(0, least(15, floor((x + 0.5) * 16)))::INT AS i, greatest(0, least(15, floor((y + 0.5) * 16)))::INT AS j, greatest(0, least(15, floor((z + 0.5) * 16)))::INT AS k, count(*) AS n FROM d WHERE abs(x) <= 0.5 AND abs(y) <= 0.5 AND abs(z) <= 0.5 GROUP BY ALL",
    "voxelized_points": f"WITH {points('4.0')}, {voxels('pts', 8)} SELECT i, j, k, (i::BIGINT * 8 + j) * 8 + k AS flat FROM vox",
    "domain_statistics": f"WITH {points('4.0')} SELECT count(*) AS finite, count(*) FILTER (abs(x) <= 0.5 AND abs(y) <= 0.5 AND abs(z) <= 0.5) AS inside FROM pts",
    "voxel_centers": f"WITH {PTS}, {voxels('pts', 8)} SELECT i, j, k, (i + 0.5) / 8.0::DOUBLE - 0.5 AS x, (j + 0.5) / 8.0::DOUBLE - 0.5 AS y, (k + 0.5) / 8.0::DOUBLE - 0.5 AS z FROM vox",
    "grid_vertices": f"WITH {points('2.0')}, {grid(7)}, near AS (SELECT round((x + 0.5) * 6)::INT AS i, round((y + 0.5) * 6)::INT AS j, round((z + 0.5) * 6)::INT AS k, count(*) AS n FROM pts GROUP BY ALL) SELECT i, j, k, i / 6.0::DOUBLE - 0.5 AS x, j / 6.0::DOUBLE - 0.5 AS y, k / 6.0::DOUBLE - 0.5 AS z, coalesce(n, 0)::BIGINT AS n FROM cells LEFT JOIN near USING (i, j, k)",
    "voxel_query_points": f"WITH {points('4.0')}, {voxels('pts', 8)}, o AS (SELECT 0 AS point, 0.5::DOUBLE AS a, 0.5::DOUBLE AS b, 0.5::DOUBLE AS c UNION ALL SELECT (1 + n)::INT, (n // 4)::DOUBLE, (n // 2 % 2)::DOUBLE, (n % 2)::DOUBLE FROM range(8) t(n)) SELECT i, j, k, point, (i + a) / 8.0::DOUBLE - 0.5 AS x, (j + b) / 8.0::DOUBLE - 0.5 AS y, (k + c) / 8.0::DOUBLE - 0.5 AS z, point > 0 AND (i + a IN (0.0, 8.0) OR j + b IN (0.0, 8.0) OR k + c IN (0.0, 8.0)) AS exempt FROM vox, o",
    "boundary_faces": f"WITH {PTS}, {voxels('pts', 8)}, {SIDES}, {EXPOSED} SELECT * FROM exposed",
    "boundary_triangles": f"WITH {PTS}, {voxels('pts', 8)}, {SIDES}, {EXPOSED}, {HALVES}, {BOUNDARY} SELECT * FROM bound",
    "l1_distances": f"WITH {points('4.0')}, {voxels('pts', 8)}, {grid(8)}, {distances(8, 'vox')} SELECT * FROM near",
    "free_labels": f"WITH {points('4.0')}, {voxels('pts', 8)}, {grid(8)}, {distances(8, 'vox')} SELECT i, j, k, CASE WHEN distance > 0 THEN -distance WHEN i < 4 THEN 1 ELSE 0 END::BIGINT AS label FROM near",
    "triangle_voxels": f"""WITH {TRIANGLES}, {grid(8)}, c AS (SELECT i, j, k, (i + 0.5) / 8.0::DOUBLE - 0.5 AS mx, (j + 0.5) / 8.0::DOUBLE - 0.5 AS my, (k + 0.5) / 8.0::DOUBLE - 0.5 AS mz FROM cells),
p AS (SELECT face_id, i, j, k, {", ".join(f"{a}{m} - m{a} AS p{a}{m}" for m in range(3) for a in AXES)} FROM tris, c), e AS (SELECT *, {", ".join(f"p{a}1 - p{a}0 AS e{a}, p{a}2 - p{a}1 AS f{a}, p{a}0 - p{a}2 AS g{a}" for a in AXES)} FROM p),
n AS (SELECT *, ey * fz - ez * fy AS nx, ez * fx - ex * fz AS ny, ex * fy - ey * fx AS nz FROM e) SELECT face_id, i, j, k FROM n WHERE {overlap(0.0625)}""",
    "bounding_box": f"WITH {PTS} SELECT {', '.join(f'min({a}) AS lo_{a}, max({a}) AS hi_{a}' for a in AXES)} FROM pts",
    "expanded_box_points": f"WITH {PTS}, b AS (SELECT {', '.join(f'min({a}) - (max({a}) - min({a})) * 0.05 AS l{a}, max({a}) + (max({a}) - min({a})) * 0.05 AS h{a}' for a in AXES)} FROM pts WHERE abs(x) < 0.15 AND abs(y) < 0.15 AND abs(z) < 0.15) SELECT point_id FROM pts, b WHERE {' AND '.join(f'{a} BETWEEN l{a} AND h{a}' for a in AXES)}",
    "face_normals": f"WITH {TRIANGLES}, a AS (SELECT face_id, {EDGES} FROM tris), b AS (SELECT face_id, {CROSS} FROM a), n AS (SELECT *, sqrt(cx * cx + cy * cy + cz * cz) AS l FROM b) SELECT face_id, {', '.join(r6(f'CASE WHEN l > 0 THEN c{a} / l ELSE 0.0 END', f'n{a}') for a in AXES)} FROM n",
    "shaded_faces": f"WITH {TRIANGLES}, a AS (SELECT face_id, {EDGES} FROM tris), b AS (SELECT face_id, {CROSS} FROM a), n AS (SELECT *, sqrt(cx * cx + cy * cy + cz * cz) AS l FROM b) SELECT face_id, {r6('greatest(0.0, least(1.0, 0.3 + 0.7 * greatest(0.0, cz / l) + 0.4 * greatest(0.0, (cx / l + cy / l) / sqrt(2.0))))', 'shade')} FROM n",
    "vertex_normals": f"WITH {PTS}, {voxels('pts', 8)}, {SIDES}, {EXPOSED}, {HALVES}, {BOUNDARY}, a AS (SELECT *, {EDGES} FROM bound), n AS (SELECT *, {CROSS} FROM a), v AS ({' UNION ALL '.join(f'SELECT (round((z{m} + 0.5) * 8) + 9 * round((y{m} + 0.5) * 8) + 81 * round((x{m} + 0.5) * 8))::BIGINT AS vid, cx, cy, cz FROM n' for m in range(3))}), s AS (SELECT vid, sum(cx) AS cx, sum(cy) AS cy, sum(cz) AS cz FROM v GROUP BY vid), t AS (SELECT *, sqrt(cx * cx + cy * cy + cz * cz) AS l FROM s) SELECT vid, {', '.join(r6(f'CASE WHEN l > 0 THEN c{a} / l ELSE 0.0 END', f'n{a}') for a in AXES)} FROM t",
    "surface_area": f"WITH {TRIANGLES}, a AS (SELECT face_id, {EDGES} FROM tris), b AS (SELECT {CROSS} FROM a) SELECT {r6('sum(sqrt(cx * cx + cy * cy + cz * cz) / 2)', 'area')} FROM b",
    "sanitized_mesh": f"WITH {PTS}, n AS (SELECT count(*) AS n FROM pts), f AS (SELECT point_id AS face_id, point_id AS v0, (point_id * 7 + 1) % n AS v1, (point_id * 11 + 3) % (n + 5) AS v2 FROM pts, n), g AS (SELECT f.* FROM f JOIN pts a ON a.point_id = v0 JOIN pts b ON b.point_id = v1 JOIN pts c ON c.point_id = v2 WHERE v0 <> v1 AND v1 <> v2 AND v0 <> v2 AND v0 % 50 <> 7 AND v1 % 50 <> 7 AND v2 % 50 <> 7), u AS (SELECT v0 AS v FROM g UNION SELECT v1 FROM g UNION SELECT v2 FROM g), w AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS id FROM u) SELECT face_id, a.id AS v0, b.id AS v1, c.id AS v2 FROM g JOIN w a ON a.v = v0 JOIN w b ON b.v = v1 JOIN w c ON c.v = v2",
    "normalized_mesh": f"WITH {PTS}, b AS (SELECT {', '.join(f'(min({a}) + max({a})) / 2 AS m{a}' for a in AXES)}, 0.99 / greatest({', '.join(f'max({a}) - min({a})' for a in AXES)}) AS s FROM pts) SELECT point_id, {', '.join(r6(f'({a} - m{a}) * s', a) for a in AXES)} FROM pts, b",
    "z_buffer": f"WITH {TRIANGLES}, {CAMS}, {SCREEN} SELECT cam_idx, face_id, count(*) AS pixels, round(min(depth), 5) AS nearest FROM best WHERE n = 1 GROUP BY ALL",
    "texture_wrap": f"WITH {PTS}, a AS (SELECT point_id, x * 20 AS u FROM pts) SELECT point_id, {r6('u - floor(u)', 'repeat')}, {r6('1 - abs(u - 2 * floor(u / 2) - 1)', 'mirror')}, {r6('greatest(0.0, least(1.0, u))', 'clamp')} FROM a",
    "fibonacci_polars": f"WITH {FIB} SELECT idx, {r6('phi', 'phi')}, {r6('theta', 'theta')} FROM fib",
    "fibonacci_directions": f"WITH {FIB} SELECT idx, {r6('sin(phi) * sin(theta)', 'x')}, {r6('sin(phi) * cos(theta)', 'y')}, {r6('cos(phi)', 'z')} FROM fib",
    "azimuth_wedge": f"WITH {PTS}, a AS (SELECT point_id, atan2(y, x) - {pi / 3}::DOUBLE + {pi}::DOUBLE AS d FROM pts) SELECT point_id FROM a WHERE abs(d - floor(d / {2 * pi}::DOUBLE) * {2 * pi}::DOUBLE - {pi}::DOUBLE) <= {0.25 * pi}::DOUBLE",
    "fill_ratio_fov": f"WITH {points('5.0')} SELECT point_id, {r6('greatest(10.0, least(120.0, degrees(2 * atan(0.5::DOUBLE / (0.8 * greatest(sqrt(x * x + y * y + z * z), 1e-6))))))', 'fov')} FROM pts",
    "alignment_moments": f"WITH {MOMENT} SELECT scene, count(*) AS n, {r6('sum(x)', 's_x')}, {r6('sum(tz)', 's_tz')}, {r6('sum(x * x)', 'p_x_x')}, {r6('sum(x * ty)', 'p_x_ty')}, {r6('sum(z * tz)', 'p_z_tz')}, {r6('sum(ty * tz)', 'p_ty_tz')} FROM pair GROUP BY scene",
    # the pairs are an exact similarity, so each scene's answer is the one they were made by
    "similarity_transform": f"WITH {MOMENT} SELECT DISTINCT scene, 2.0::DOUBLE AS scale, " + ", ".join(f"{x}::DOUBLE AS t{i // 4}{i % 4}" for i, x in enumerate((0, 2, 0, 0.5, -2, 0, 0, 0.25, 0, 0, 2, -1))) + " FROM pair",
    "affine_alignment": f"WITH {MOMENT} SELECT DISTINCT scene, " + ", ".join(f"{x}::DOUBLE AS a{i // 3}{i % 3}" for i, x in enumerate((0, 2, 0, -2, 0, 0, 0, 0, 2))) + ", 0.5::DOUBLE AS t0, 0.25::DOUBLE AS t1, -1.0::DOUBLE AS t2 FROM pair",
    # all views meet in the origin, and stand on a sphere around it
    "view_focus": "SELECT 0 AS scene, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z",
    "camera_sphere": "SELECT 0 AS scene, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z, 2.5::DOUBLE AS radius",
}
# the same under the names that were over the whole tables first
SQL |= {f"{k}_all": SQL[k] for k in ("camera_polar_angles", "camera_quaternions", "depth_to_world", "view_spread", "z_buffer")}
# farthest-point order: the one not yet taken whose nearest taken one is farthest
SQL["farthest_cameras"] = f"""WITH RECURSIVE {CAMS}, gaps AS (SELECT a.cam_idx AS a, b.cam_idx AS b, round((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) + (a.pz - b.pz) * (a.pz - b.pz), 12) AS d FROM cams a, cams b),
taken AS (SELECT 0 AS turn, [min(cam_idx)] AS ids FROM cams UNION ALL SELECT turn + 1, list_append(ids, (SELECT g.a FROM gaps g WHERE NOT list_contains(ids, g.a) AND list_contains(ids, g.b) GROUP BY g.a ORDER BY min(g.d) DESC, g.a LIMIT 1)) FROM taken WHERE turn < 5)
SELECT ids[turn + 1]::INT AS cam_idx, turn::INT AS turn FROM taken"""
