"""The queries of scenes.py in SQL over the same tables; those without SQL are tested against brute force."""

from __future__ import annotations

from .oracle import SQL as OTHER
from .oracle import AXES, BOUNDARY, CAMS, CROSS, EDGES, EXPOSED, FX, HALVES, PIXELS, PTS, SCREEN, SIDES, TRIANGLES, H, W, angle, cameras, distances, grid, points, r6, voxels

RIG = f"{cameras('2.5', '0.3')}, rig AS (SELECT *, cam_idx % 2 AS scene FROM cams)"
HOLED = PIXELS + """, holed AS (SELECT * REPLACE (CASE WHEN ("row" * 40 + col) % 7 = 3 THEN 0.0 ELSE depth END AS depth) FROM pix)"""
GOOD = "mask AND depth > 1e-5 AND depth < 1e5"
WORLD = f"""seen AS (SELECT p.*, (((col + 0.5) / 40.0::DOUBLE) * {W} - 0.5 - {W / 2}) * depth / {FX} - t0 AS a, ((1 - ("row" + 0.5) / 25.0::DOUBLE) * {H} - 0.5 - {H / 2}) * depth / {FX} - t1 AS b, -depth - t2 AS d, r00, r10, r20, r01, r11, r21, r02, r12, r22 FROM holed p JOIN cams USING (cam_idx)),
world AS (SELECT *, {", ".join(f"r0{i} * a + r1{i} * b + r2{i} * d AS {a}" for i, a in enumerate(AXES))} FROM seen)"""


def quantile(share: float) -> str:
    return f"least AS (SELECT cam_idx, conf AS least FROM (SELECT cam_idx, conf, row_number() OVER (PARTITION BY cam_idx ORDER BY conf) AS r, count(*) OVER (PARTITION BY cam_idx) AS n FROM pix) WHERE r = floor({share} * (n - 1)) + 1)"


def r5(e: str, name: str) -> str:
    return f"round({e}, 5) + 0.0 AS {name}"


def rows(m: list[list[str]], name: str = "m", number=r6) -> str:
    return ", ".join(number(f"({e})::DOUBLE", f"{name}{i}{j}") for i, row in enumerate(m) for j, e in enumerate(row))


#: From a scene's up direction (a, b, c) and its first camera's view: tilt up to z, then turn the level part of the view to -x.
FRAME = """tilted AS (SELECT scene, 1 - a * a / (1 + c) AS q00, -a * b / (1 + c) AS q01, -a AS q02, 1 - b * b / (1 + c) AS q11, -b AS q12, a AS q20, b AS q21, c AS q22, fx, fy, fz FROM main),
level AS (SELECT *, q00 * fx + q01 * fy + q02 * fz AS lx, q01 * fx + q11 * fy + q12 * fz AS ly FROM tilted),
spun AS (SELECT *, -lx / sqrt(lx * lx + ly * ly) AS co, ly / sqrt(lx * lx + ly * ly) AS si FROM level)"""
TURNED = [["co * q00 - si * q01", "co * q01 - si * q11", "co * q02 - si * q12", "0.0"], ["si * q00 + co * q01", "si * q01 + co * q11", "si * q02 + co * q12", "0.0"], ["q20", "q21", "q22", "0.0"]]
FIRST = "firsts AS (SELECT scene, arg_min(-r20, cam_idx) AS fx, arg_min(-r21, cam_idx) AS fy, arg_min(-r22, cam_idx) AS fz FROM rig GROUP BY scene)"


def sphere(source: str, name: str) -> str:
    """Closed form of p = centre + radius * b: sums of p, of b, and of p with b."""
    dot = lambda a, b: " + ".join(f"{a}{k} * {b}{k}" for k in AXES)
    return f"""{name}_s AS (SELECT scene, count(*)::DOUBLE AS n, {", ".join(f"sum(p{a}) AS sp{a}, sum(b{a}_) AS sb{a}" for a in AXES)}, sum({" + ".join(f"p{a} * b{a}_" for a in AXES)}) AS pb FROM {source} GROUP BY scene),
{name}_r AS (SELECT *, (pb - ({dot("sp", "sb")}) / n) / (n - ({dot("sb", "sb")}) / n) AS radius FROM {name}_s),
{name} AS (SELECT scene, n, radius, {", ".join(f"(sp{a} - radius * sb{a}) / n AS {a}" for a in AXES)} FROM {name}_r)"""


def taps(n: int, to: int, t: str) -> str:
    """The two old places around each new one, with their shares, as rows (t, at, share)."""
    at = f"greatest(0.0, (t + 0.5) * ({n} / {to}::DOUBLE) - 0.5)"
    return f"{t}_at AS (SELECT t, {at} AS x FROM range({to}) r(t)), {t} AS (SELECT t, floor(x)::INT AS at, 1 - (x - floor(x)) AS share FROM {t}_at UNION ALL SELECT t, least({n - 1}, floor(x) + 1)::INT, x - floor(x) FROM {t}_at)"


SPHERE_FIT = f"""WITH {RIG}, far AS (SELECT scene, cam_idx, CASE WHEN cam_idx % 11 = 5 THEN 1.5 ELSE 1 + (cam_idx % 5) / 100.0::DOUBLE END AS f, px, py, pz, r20 AS bx_, r21 AS by_, r22 AS bz_ FROM rig),
moved AS (SELECT scene, cam_idx, px * f AS px, py * f AS py, pz * f AS pz, bx_, by_, bz_ FROM far), {sphere("moved", "one")},
off AS (SELECT m.*, sqrt({" + ".join(f"(p{a} - o.{a} - radius * b{a}_) ** 2" for a in AXES)}) AS off FROM moved m JOIN one o USING (scene)),
mid AS (SELECT scene, quantile_disc(off, 0.5) AS mid FROM off GROUP BY scene), dev AS (SELECT scene, quantile_disc(abs(off - mid), 0.5) AS dev FROM off JOIN mid USING (scene) GROUP BY scene),
near AS (SELECT off.* FROM off JOIN mid USING (scene) JOIN dev USING (scene) WHERE off <= mid + 3 * 1.4826 * greatest(dev, 1e-8)), {sphere("near", "two")}
SELECT scene, {", ".join(r5(f"CASE WHEN two.n >= greatest(2, floor(0.5 * one.n)) AND two.n < one.n AND two.radius > 0 THEN two.{k} ELSE one.{k} END", k) for k in (*AXES, "radius"))} FROM one JOIN two USING (scene)"""

BARY = SCREEN.replace("1 / ((e0 / w0 + e1 / w1 + e2 / w2) / (e0 + e1 + e2)) AS depth FROM edges", "1 / ((e0 / w0 + e1 / w1 + e2 / w2) / (e0 + e1 + e2)) AS depth, (e1 / w1 + 2 * e2 / w2) / (e0 / w0 + e1 / w1 + e2 / w2) AS mixed FROM edges")
NORMALS = f"na AS (SELECT face_id, {EDGES} FROM tris), nb AS (SELECT face_id, {CROSS} FROM na), nn AS (SELECT *, sqrt(cx * cx + cy * cy + cz * cz) AS l FROM nb), norms AS (SELECT face_id, {', '.join(f'CASE WHEN l > 0 THEN c{a} / l ELSE 0.0 END AS n{a}' for a in AXES)} FROM nn)"
TURN = {"x": "r0", "y": "r1", "z": "r2"}

SQL: dict[str, str] = {
    "camera_intrinsic_matrix": f"SELECT n_nationkey::INT AS cam_idx, {rows([[FX, '0.0', str(W / 2)], ['0.0', FX, str(H / 2)], ['0.0', '0.0', '1.0']], 'k')} FROM nation",
    "camera_from_matrices": f"WITH {CAMS} SELECT cam_idx, {W} AS width, {H} AS height, 60.0::DOUBLE AS fovx, TRUE AS square, {rows([[f'r{i}0', f'r{i}1', f'r{i}2', f't{i}'] for i in range(3)])} FROM cams",
    "camera_resized": f"SELECT n_nationkey::INT AS cam_idx, {r6('200 / (2 * tan(radians(40.0 + n_nationkey) / 2))', 'fx')}, {r6('200 / (2 * tan(radians(40.0 + n_nationkey) / 2))', 'fy')}, 100.0::DOUBLE AS cx, 50.0::DOUBLE AS cy FROM nation",
    "points_span": f"WITH {PTS}, b AS (SELECT {', '.join(f'(min({a}) + max({a})) / 2 AS m{a}' for a in AXES)} FROM pts) SELECT {', '.join(r6(f'any_value(m{a})', f'm{a}') for a in AXES)}, {r6('max(sqrt((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2))', 'radius')} FROM pts, b",
    "focused_cameras": f"WITH {PTS}, {cameras('2.5', '0.3')}, b AS (SELECT {', '.join(f'(min({a}) + max({a})) / 2 AS m{a}' for a in AXES)} FROM pts), s AS (SELECT mx, my, mz, 2.5 * max(sqrt((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2)) * {FX} / ({H} * 0.95) AS away FROM pts, b GROUP BY ALL) SELECT cam_idx, {', '.join(r5(f'm{a} + away * r2{i}', f'p{a}') for i, a in enumerate(AXES))}, {', '.join(r5(f'-r2{i}', f'f{a}') for i, a in enumerate(AXES))} FROM cams, s",
    "transformed_cameras": f"WITH {RIG} SELECT cam_idx, 2.0::DOUBLE AS scale, {r6('-2 * py + 1', 'px')}, {r6('2 * px - 0.5', 'py')}, {r6('2 * pz + 0.25', 'pz')}, {r6('r21', 'fx')}, {r6('-r20', 'fy')}, {r6('-r22', 'fz')}, {r6('-r11', 'ux')}, {r6('r10', 'uy')}, {r6('r12', 'uz')} FROM rig",
    "transformed_depths": f"WITH {PIXELS} SELECT cam_idx, {r6('sum(2 * depth)', 'total')} FROM pix WHERE cam_idx < 25 GROUP BY cam_idx",
    "similarity_inverse": f"SELECT scene, 2.0::DOUBLE AS scale, {rows([['0.0', '1.0', '0.0'], ['-1.0', '0.0', '0.0'], ['0.0', '0.0', '1.0']], 'r')}, {rows([['0.0', '-0.5', '0.0', '0.125'], ['0.5', '0.0', '0.0', '-0.25'], ['0.0', '0.0', '0.5', '0.5']])} FROM (SELECT DISTINCT vec_id % 3 AS scene FROM embeddings)",
    "mean_up_frame": f"WITH {RIG}, {FIRST}, ups AS (SELECT scene, sum(r10) AS x, sum(r11) AS y, sum(r12) AS z FROM rig GROUP BY scene), main AS (SELECT scene, x / sqrt(x * x + y * y + z * z) AS a, y / sqrt(x * x + y * y + z * z) AS b, z / sqrt(x * x + y * y + z * z) AS c, fx, fy, fz FROM ups JOIN firsts USING (scene)), {FRAME} SELECT scene, {rows(TURNED, number=r5)} FROM spun",
    "cluster_up_frame": f"WITH {RIG}, {FIRST}, near AS (SELECT a.scene, a.cam_idx AS heart, b.cam_idx FROM rig a JOIN rig b ON a.scene = b.scene AND a.r10 * b.r10 + a.r11 * b.r11 + a.r12 * b.r12 >= cos(radians(60.0))), sizes AS (SELECT scene, heart, count(*) AS members FROM near GROUP BY ALL), best AS (SELECT scene, heart, members, row_number() OVER (PARTITION BY scene ORDER BY members DESC, heart) AS n FROM sizes), whole AS (SELECT scene, count(*) AS n FROM rig GROUP BY scene), picked AS (SELECT n.scene, n.cam_idx FROM near n JOIN best b ON b.scene = n.scene AND b.heart = n.heart AND b.n = 1 JOIN whole w ON w.scene = n.scene WHERE members >= greatest(1, ceil(0.1 * w.n))), chosen AS (SELECT r.* FROM rig r WHERE r.scene NOT IN (SELECT scene FROM picked) UNION ALL SELECT r.* FROM rig r JOIN picked USING (scene, cam_idx)), ups AS (SELECT scene, sum(r10) AS x, sum(r11) AS y, sum(r12) AS z FROM chosen GROUP BY scene), main AS (SELECT scene, x / sqrt(x * x + y * y + z * z) AS a, y / sqrt(x * x + y * y + z * z) AS b, z / sqrt(x * x + y * y + z * z) AS c, fx, fy, fz FROM ups JOIN firsts USING (scene)), {FRAME} SELECT scene, {rows(TURNED, number=r5)} FROM spun",
    "camera_sphere_fit": SPHERE_FIT,
    # the rig's sphere has radius 2.5 around the origin
    "sphere_frame": f"WITH fit AS ({SPHERE_FIT.replace('round(', '(').replace(', 5) + 0.0 AS', ') AS')}) SELECT scene, {rows([[('4.0 / radius' if i == j else '0.0') if j < 3 else f'-4.0 / radius * {AXES[i]}' for j in range(4)] for i in range(3)], number=r5)} FROM fit",
    "image_order": "WITH n AS (SELECT n_nationkey::INT % 2 AS scene, n_nationkey::INT AS cam_idx FROM nation), m AS (SELECT scene, 24 - cam_idx AS cam_idx, 'im' || CASE WHEN scene = 1 AND cam_idx = 3 THEN 5 ELSE cam_idx END AS image_id FROM n), own AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY cam_idx) - 1 AS t FROM m), refs AS (SELECT scene, 'im' || cam_idx AS image_id, row_number() OVER (PARTITION BY scene ORDER BY cam_idx) - 1 AS place FROM n) SELECT o.scene, o.image_id, o.cam_idx, (CASE WHEN o.scene = 0 THEN place ELSE t END)::INT AS turn FROM own o LEFT JOIN refs r ON o.scene = r.scene AND o.image_id = r.image_id",
    "scene_radii": f"WITH {RIG}, m AS (SELECT scene, avg(px) AS mx, avg(py) AS my, avg(pz) AS mz FROM rig GROUP BY scene), a AS (SELECT a.scene, round(max({angle(*[(f'a.r2{i}', f'b.r2{i}') for i in range(3)])}), 4) AS spread FROM rig a JOIN rig b ON a.scene = b.scene AND a.cam_idx < b.cam_idx GROUP BY a.scene), r AS (SELECT scene, {r6('median(sqrt((px - mx) ** 2 + (py - my) ** 2 + (pz - mz) ** 2))', 'radius')} FROM rig JOIN m USING (scene) GROUP BY scene) SELECT * FROM r JOIN a USING (scene)",
    "depth_view": f"""WITH {HOLED}, b AS (SELECT cam_idx, min(depth) AS lo, max(depth) AS hi FROM holed WHERE {GOOD} GROUP BY cam_idx) SELECT cam_idx, "row", col, {r6(f"CASE WHEN {GOOD} THEN greatest(0.0, least(1.0, (depth - lo) / (hi - lo + 1e-8))) ELSE 1.0 END", "shade")} FROM holed LEFT JOIN b USING (cam_idx)""",
    "masked_depth": f"""WITH {HOLED}, {quantile(0.5)} SELECT cam_idx, "row", col, CASE WHEN {GOOD} AND conf >= least THEN depth ELSE 0.0 END AS depth FROM holed JOIN least USING (cam_idx)""",
    "world_colors": f"""WITH {CAMS}, {HOLED}, {WORLD} SELECT cam_idx, "row", col, {", ".join(r6(f"CASE WHEN {GOOD} THEN greatest(0.0, least(1.0, {a} + 0.5)) ELSE 1.0 END", a) for a in AXES)} FROM world""",
    "depth_cloud": f"""WITH {CAMS}, {HOLED}, {quantile(0.8)}, {WORLD} SELECT cam_idx, "row", col, {", ".join(r6(a, a) for a in AXES)}, conf, {r6("conf / 500", "r")} FROM world JOIN least USING (cam_idx) WHERE {GOOD} AND conf >= least""",
    "resampled_mask": f"""WITH {PIXELS}, k AS (SELECT DISTINCT cam_idx FROM pix), g AS (SELECT cam_idx, r.r::INT AS "row", c.c::INT AS col, greatest(0, least(24, round_even((r.r + 0.5) / 31.0::DOUBLE * 25 - 0.5, 0)))::INT AS pr, greatest(0, least(39, round_even((c.c + 0.5) / 57.0::DOUBLE * 40 - 0.5, 0)))::INT AS pc FROM k, range(31) r(r), range(57) c(c)) SELECT g.cam_idx, g."row", g.col, p.mask FROM g LEFT JOIN pix p ON p.cam_idx = g.cam_idx AND p."row" = pr AND p.col = pc""",
    "resized_confidence": f"""WITH {PIXELS}, {taps(25, 31, "tr")}, {taps(40, 57, "tc")} SELECT p.cam_idx, tr.t::INT AS "row", tc.t::INT AS col, round(sum(tr.share * tc.share * conf) / sum(tr.share * tc.share), 4) AS conf FROM pix p JOIN tr ON tr.at = p."row" JOIN tc ON tc.at = p.col GROUP BY p.cam_idx, tr.t, tc.t HAVING sum(tr.share * tc.share) > 0""",
    "queried_pixels": f"""WITH {CAMS}, {HOLED}, a AS (SELECT floor(event_id / 1000)::INT AS cam_idx, event_id AS id, (event_id * 37 % 1009) / 1009.0::DOUBLE AS u, (event_id * 53 % 997) / 997.0::DOUBLE AS v FROM events), q AS (SELECT *, greatest(0, least(24, trunc((1 - v) * 25)))::INT AS r, greatest(0, least(39, trunc(u * 40)))::INT AS c FROM a), s AS (SELECT q.id, p.conf, p.depth > 1e-5 AND p.depth < 1e5 AS valid, (u * {W} - 0.5 - {W / 2}) * depth / {FX} - t0 AS a, (v * {H} - 0.5 - {H / 2}) * depth / {FX} - t1 AS b, -depth - t2 AS d, k.* FROM q JOIN holed p ON p.cam_idx = q.cam_idx AND p."row" = r AND p.col = c JOIN cams k ON k.cam_idx = q.cam_idx) SELECT id, {", ".join(r6(f"r0{i} * a + r1{i} * b + r2{i} * d", a) for i, a in enumerate(AXES))}, conf, valid FROM s""",
    "camera_normals": f"""WITH {CAMS}, {PIXELS}, n AS (SELECT cam_idx, "row", col, mask, conf - 200 AS a, "row" - 12.2::DOUBLE AS b, col - 19.7::DOUBLE AS c FROM pix), l AS (SELECT *, sqrt(a * a + b * b + c * c) AS l FROM n) SELECT cam_idx, "row", col, {", ".join(r6(f"CASE WHEN mask THEN ({t}0 * a + {t}1 * b + {t}2 * c) / l * 0.5 + 0.5 ELSE 1.0 END", f"n{k}") for k, t in TURN.items())} FROM l JOIN cams USING (cam_idx)""",
    "foreground_boxes": f"""WITH {PIXELS}, p AS (SELECT cam_idx, "row" AS r, col AS c, CASE WHEN conf > 300 THEN conf / 500 ELSE 1.0 END AS v FROM pix), b AS (SELECT cam_idx, min(r) - 1 AS r0, max(r) + 1 AS r1, min(c) - 1 AS c0, max(c) + 1 AS c1 FROM p WHERE abs(v - 1.0) > 40 / 255.0::DOUBLE GROUP BY cam_idx), g AS (SELECT cam_idx, unnest(range(r0, r1 + 1)) AS r, r0, c0, c1 FROM b), h AS (SELECT cam_idx, r, unnest(range(c0, c1 + 1)) AS c, r0, c0 FROM g) SELECT h.cam_idx, (h.r - r0)::INT AS "row", (h.c - c0)::INT AS col, {r6("coalesce(v, 1.0)", "r")} FROM h LEFT JOIN p ON p.cam_idx = h.cam_idx AND p.r = h.r AND p.c = h.c""",
    "unpadded_images": f"""WITH {PIXELS} SELECT cam_idx, ("row" - cam_idx % 5)::INT AS "row", (col - cam_idx % 7)::INT AS col, conf FROM pix WHERE cam_idx < 25 AND col >= cam_idx % 7 AND col < 30 + cam_idx % 10 AND "row" >= cam_idx % 5 AND "row" < 20 + cam_idx % 3""",
    "rendered_normals": f"WITH {TRIANGLES}, {CAMS}, {SCREEN}, {NORMALS} SELECT b.cam_idx, count(*) AS pixels, {', '.join(f'round(avg(n{a}), 5) AS n{a}' for a in AXES)}, {', '.join(f'round(avg({t}0 * nx + {t}1 * ny + {t}2 * nz), 5) AS m{k}' for k, t in TURN.items())} FROM best b JOIN norms USING (face_id) JOIN cams c ON c.cam_idx = b.cam_idx WHERE n = 1 GROUP BY b.cam_idx",
    "rendered_corners": f"WITH {TRIANGLES}, {CAMS}, {BARY} SELECT cam_idx, face_id, round(avg(mixed), 5) AS mixed FROM best WHERE n = 1 GROUP BY ALL",
    "camera_sees_any": f"WITH {TRIANGLES}, {CAMS}, {SCREEN} SELECT cam_idx, cam_idx IN (SELECT cam_idx FROM frag) AS \"any\" FROM cams",
    "textured_points": f"""WITH {PTS}, {PIXELS}, t AS (SELECT "row" AS r, col AS c, conf FROM pix WHERE cam_idx = 0), a AS (SELECT point_id, (x * 3 + 0.5) - floor(x * 3 + 0.5) AS u, (y * 3 + 0.5) - floor(y * 3 + 0.5) AS v FROM pts), s AS (SELECT point_id, u * 40 - 0.5 AS sx, (1 - v) * 25 - 0.5 AS sy FROM a), f AS (SELECT point_id, floor(sx)::INT AS ix, floor(sy)::INT AS iy, sx - floor(sx) AS gx, sy - floor(sy) AS gy FROM s), d(dx, dy) AS (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) SELECT point_id, round(sum(CASE dx WHEN 1 THEN gx ELSE 1 - gx END * CASE dy WHEN 1 THEN gy ELSE 1 - gy END * conf), 4) AS conf FROM f, d JOIN t ON t.c = (ix + dx + 40) % 40 AND t.r = (iy + dy + 25) % 25 GROUP BY point_id""",
    "frustum_corners": f"WITH {CAMS}, k(corner, u, v) AS (VALUES (1, 0.0, 0.0), (2, 1.0, 0.0), (3, 1.0, 1.0), (4, 0.0, 1.0)), s AS (SELECT *, (u * {W} - 0.5 - {W / 2}) * 2 / {FX} - t0 AS a, (v * {H} - 0.5 - {H / 2}) * 2 / {FX} - t1 AS b, -2 - t2 AS d FROM cams, k) SELECT cam_idx, corner, {', '.join(r6(f'r0{i} * a + r1{i} * b + r2{i} * d', a) for i, a in enumerate(AXES))} FROM s UNION ALL SELECT cam_idx, 0, {', '.join(r6(f'p{a}', a) for a in AXES)} FROM cams",
    "line_segments": f"WITH {PTS} SELECT point_id, {', '.join(r6(a, f'{a}0') for a in AXES)}, {', '.join(r6(f'{a} + {k}', f'{a}1') for k, a in enumerate(AXES))} FROM pts",
    "fibonacci_rotations": "WITH f AS (SELECT id AS idx, acos(greatest(-1.0, least(1.0, 1 - 2 * id / ((SELECT count(*) FROM embeddings) - 1)::DOUBLE))) AS p, id * 2.399963229728653::DOUBLE AS t FROM range((SELECT count(*) FROM embeddings)) t(id)) SELECT idx, " + rows([["cos(p) * cos(t)", "-sin(p)", "cos(p) * sin(t)"], ["sin(p) * cos(t)", "cos(p)", "sin(p) * sin(t)"], ["-sin(t)", "0.0", "cos(t)"]], "r") + " FROM f",
}
SQL["vertex_colors"] = "SELECT n_nationkey::INT AS cam_idx, TRUE AS exact FROM nation"


def marked(pts: str, masked: bool = False) -> str:
    """All steps of the labels of points seen by all cameras: faces, pixels, visible voxels, proofs of emptiness, distances. masked: triangles count too,
    the depth pixels' masks gate what is seen and empty the rays outside, and the points at three times their place stay unknown."""
    near = lambda e, n: f"greatest(0, least({n - 1}, round_even({e} * {n} - 0.5, 0)))::INT"
    has = "{0}.cam_idx IN (SELECT cam_idx FROM pix)"
    project = f"""seen_points AS (SELECT cam_idx, i, j, k, exempt, r00 * x + r01 * y + r02 * z + t0 AS a, r10 * x + r11 * y + r12 * z + t1 AS b, -(r20 * x + r21 * y + r22 * z + t2) AS depth FROM query, cams),
placed AS (SELECT *, CASE WHEN depth > 1e-6 THEN ({FX} * a / depth + {W / 2} + 0.5) / {W} END AS u, CASE WHEN depth > 1e-6 THEN ({FX} * b / depth + {H / 2} + 0.5) / {H} END AS v FROM seen_points),
framed AS (SELECT *, coalesce(u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1, FALSE) AS inside FROM placed),
pixels AS (SELECT *, CASE WHEN inside THEN greatest(0, least({W - 1}, trunc(u * {W})))::INT END AS pc, CASE WHEN inside THEN greatest(0, least({H - 1}, trunc((1 - v) * {H})))::INT END AS pr FROM framed),
proofs AS (SELECT p.cam_idx, i, j, k FROM pixels p LEFT JOIN nearest s ON s.cam_idx = p.cam_idx AND s.r = pr AND s.c = pc GROUP BY ALL HAVING bool_and(exempt OR (inside AND coalesce(p.depth < s.depth - greatest(abs(p.depth) * 1e-4, 1e-6), FALSE)))),
free AS (SELECT DISTINCT i, j, k FROM proofs)"""
    shown, occupied = "nearest", voxels("pts", 8)
    if masked:
        shown = f"""(SELECT n.* FROM nearest n LEFT JOIN pix m ON m.cam_idx = n.cam_idx AND m."row" = {near(f"((n.r + 0.5) / {H}.0::DOUBLE)", 25)} AND m.col = {near(f"((n.c + 0.5) / {W}.0::DOUBLE)", 40)} WHERE m.mask OR NOT {has.format("n")})"""
        project = project.replace("proofs AS (SELECT p.cam_idx, i, j, k FROM pixels p LEFT JOIN", f"""masks AS (SELECT p.*, inside AND {has.format("p")} AND NOT coalesce(m.mask, FALSE) AS open FROM pixels p LEFT JOIN pix m ON m.cam_idx = p.cam_idx AND m."row" = {near("(1 - v)", 25)} AND m.col = {near("u", 40)}),
proofs AS (SELECT p.cam_idx, i, j, k FROM masks p LEFT JOIN""").replace("coalesce(p.depth < s.depth -", "coalesce(p.depth < CASE WHEN open THEN 'inf'::DOUBLE ELSE s.depth END -")
        project = project.replace("FROM proofs)", "FROM proofs ANTI JOIN kept_back USING (i, j, k))")
        occupied = f"{voxels('pts', 8, 'pv')}, tv AS ({OTHER['triangle_voxels']}), vox AS (SELECT i, j, k FROM pv UNION SELECT i, j, k FROM tv), {PIXELS}, {points('3.0', 'far')}, {voxels('far', 8, 'kept_back')}"
    return f"""WITH {CAMS}, {pts}, {occupied}, {SIDES}, {EXPOSED}, {HALVES}, {BOUNDARY}, tris AS (SELECT * FROM bound), {SCREEN},
nearest AS (SELECT cam_idx, r, c, face_id, depth FROM best WHERE n = 1), {grid(8)},
visible AS (SELECT DISTINCT (o // 64)::INT AS i, (o // 8 % 8)::INT AS j, (o % 8)::INT AS k FROM (SELECT face_id // 12 AS o FROM {shown})),
corners AS (SELECT 0 AS point, 0.5::DOUBLE AS a, 0.5::DOUBLE AS b, 0.5::DOUBLE AS c UNION ALL SELECT 1 + n, (n // 4)::DOUBLE, (n // 2 % 2)::DOUBLE, (n % 2)::DOUBLE FROM range(8) t(n)),
query AS (SELECT i, j, k, (i + a) / 8.0::DOUBLE - 0.5 AS x, (j + b) / 8.0::DOUBLE - 0.5 AS y, (k + c) / 8.0::DOUBLE - 0.5 AS z, point > 0 AND (i + a IN (0.0, 8.0) OR j + b IN (0.0, 8.0) OR k + c IN (0.0, 8.0)) AS exempt FROM cells ANTI JOIN vox USING (i, j, k), corners),
{project}, held AS (SELECT i, j, k FROM cells ANTI JOIN free USING (i, j, k)), {distances(8, 'held')}
SELECT label, count(*) AS n FROM (SELECT CASE WHEN n.distance > 0 THEN -n.distance WHEN v.i IS NOT NULL THEN 1 ELSE 0 END::BIGINT AS label FROM near n LEFT JOIN visible v USING (i, j, k)) GROUP BY label"""


SQL["mark_visible_labels"] = marked(points("2.0"))
SQL["mark_visible_depth"] = marked(f"{HOLED}, {WORLD}, pts AS (SELECT x, y, z FROM world WHERE {GOOD})")
SQL["mark_visible_masked"] = marked(points("2.0"), masked=True)
