"""The queries of structures.py in SQL over the same tables."""

from __future__ import annotations

from .oracle import AXES, BOUNDARY, CROSS, EDGES, EXPOSED, FX, HALVES, PIXELS, SCREEN, SIDES, TRIANGLES, H, W, cameras, points, r6, voxels
from .scenes_oracle import NORMALS, r5

NEAR = f"""{points('2.0')}, far AS (SELECT p.point_id AS id, o.point_id AS near_id, (o.x - p.x) ** 2 + (o.y - p.y) ** 2 + (o.z - p.z) ** 2 AS far2, o.x - p.x AS x, o.y - p.y AS y, o.z - p.z AS z FROM pts p, pts o),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(far2, 9), near_id)::INT AS rank FROM far)"""
PAIRS = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
#: Smallest eigenvalue of a symmetric matrix in closed form, and the direction across the two rows that span the rest best.
THIN = f"""sums AS (SELECT id, {", ".join(f"avg({a} * {b}) - avg({a}) * avg({b}) AS {a}{b}" for a, b in PAIRS)} FROM ranked WHERE rank <= 30 GROUP BY id),
mean AS (SELECT *, (xx + yy + zz) / 3 AS q FROM sums), wide AS (SELECT *, sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM mean),
turn AS (SELECT *, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p * p * p) AS r FROM wide),
least AS (SELECT *, q + 2 * p * cos(acos(greatest(-1.0, least(1.0, r))) / 3 + 2 * pi() / 3) AS l FROM turn),
rows_ AS (SELECT id, xx - l AS a0, xy AS a1, xz AS a2, xy AS b0, yy - l AS b1, yz AS b2, xz AS c0, yz AS c1, zz - l AS c2 FROM least),
crossed AS ({" UNION ALL ".join(f"SELECT id, {s}1 * {t}2 - {s}2 * {t}1 AS nx, {s}2 * {t}0 - {s}0 * {t}2 AS ny, {s}0 * {t}1 - {s}1 * {t}0 AS nz FROM rows_" for s, t in ("ab", "ac", "bc"))}),
best AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS n, row_number() OVER (PARTITION BY id ORDER BY nx * nx + ny * ny + nz * nz DESC) AS k FROM crossed),
signed AS (SELECT *, CASE WHEN abs(nx) >= abs(ny) AND abs(nx) >= abs(nz) THEN sign(nx) WHEN abs(ny) >= abs(nz) THEN sign(ny) ELSE sign(nz) END AS s FROM best WHERE k = 1)"""

MESH = f"{points()}, {voxels('pts', 8)}, {SIDES}, {EXPOSED}, {HALVES}, {BOUNDARY}, tris AS (SELECT * FROM bound)"
VID = [f"(round((z{m} + 0.5) * 8) + 9 * round((y{m} + 0.5) * 8) + 81 * round((x{m} + 0.5) * 8))::BIGINT" for m in range(3)]
#: The same fragments with the weights of the second and third corner.
WEIGHTED = SCREEN.replace("1 / ((e0 / w0 + e1 / w1 + e2 / w2) / (e0 + e1 + e2)) AS depth FROM edges", "1 / ((e0 / w0 + e1 / w1 + e2 / w2) / (e0 + e1 + e2)) AS depth, (e1 / w1) / (e0 / w0 + e1 / w1 + e2 / w2) AS b1, (e2 / w2) / (e0 / w0 + e1 / w1 + e2 / w2) AS b2 FROM edges")


def mixed(e: str) -> str:
    """A corner's expression, with # for its number, mixed by a pixel's weights."""
    return f"(1 - b1 - b2) * ({e.replace('#', '0')}) + b1 * ({e.replace('#', '1')}) + b2 * ({e.replace('#', '2')})"


#: Labels of parts spread from faces without a smaller neighbour to larger ones; the smallest that arrives stays.
WINDING = f"""WITH RECURSIVE {MESH}, numbered AS (SELECT face_id, {", ".join(f"{x} AS w{m}" for m, x in enumerate(VID))} FROM tris),
faces AS (SELECT face_id, w0 AS v0, CASE WHEN face_id % 3 = 0 THEN w2 ELSE w1 END AS v1, CASE WHEN face_id % 3 = 0 THEN w1 ELSE w2 END AS v2 FROM numbered),
edge AS (SELECT face_id, v0 AS s, v1 AS t FROM faces UNION ALL SELECT face_id, v1, v2 FROM faces UNION ALL SELECT face_id, v2, v0 FROM faces),
pair AS (SELECT min(face_id) AS a, max(face_id) AS b, (sum((s < t)::INT) <> 1)::INT AS odd FROM edge GROUP BY least(s, t), greatest(s, t) HAVING count(*) = 2 AND min(face_id) < max(face_id)),
link AS (SELECT a, b, odd FROM pair UNION SELECT b, a, odd FROM pair),
reached AS (SELECT face_id AS f, face_id AS part, 0 AS odd FROM faces WHERE face_id NOT IN (SELECT b FROM pair) UNION SELECT l.b, r.part, xor(r.odd, l.odd) FROM reached r JOIN link l ON l.a = r.f AND l.b > r.part),
label AS (SELECT f, min(part) AS part, arg_min(odd, part) AS odd FROM reached GROUP BY f)
SELECT face_id, part, odd = 1 AS flip, v0, CASE odd WHEN 1 THEN v2 ELSE v1 END AS v1, CASE odd WHEN 1 THEN v1 ELSE v2 END AS v2 FROM faces JOIN label ON f = face_id"""

TEXTURED = f"""WITH {TRIANGLES}, {cameras()}, {WEIGHTED}, {PIXELS}, texel AS (SELECT "row" AS r, col AS c, conf FROM pix WHERE cam_idx = 0),
placed AS (SELECT cam_idx, face_id, b.r, b.c, {mixed("x# * 3 + 0.5")} AS u, {mixed("y# * 3 + z#")} AS v FROM best b JOIN tris USING (face_id) WHERE n = 1),
wrapped AS (SELECT cam_idx, face_id, r, c, (u - floor(u)) * 40 - 0.5 AS sx, abs(v - 2 * floor(v / 2) - 1) * 25 - 0.5 AS sy FROM placed),
around AS (SELECT *, floor(sx)::INT AS ix, floor(sy)::INT AS iy, sx - floor(sx) AS gx, sy - floor(sy) AS gy FROM wrapped), d(dx, dy) AS (VALUES (0, 0), (1, 0), (0, 1), (1, 1)),
shown AS (SELECT cam_idx, face_id, a.r, a.c, sum(CASE dx WHEN 1 THEN gx ELSE 1 - gx END * CASE dy WHEN 1 THEN gy ELSE 1 - gy END * conf) AS conf FROM around a, d JOIN texel t ON t.c = (ix + dx + 40) % 40 AND t.r = greatest(0, least(24, iy + dy)) GROUP BY ALL)
SELECT cam_idx, face_id, count(*) AS pixels, round(avg(conf), 3) AS conf FROM shown GROUP BY ALL"""

LIT = f"""WITH {MESH}, {cameras()}, {WEIGHTED}, na AS (SELECT *, {EDGES} FROM tris), nb AS (SELECT face_id, {", ".join(f"{x} AS v{m}" for m, x in enumerate(VID))}, {CROSS} FROM na),
corner_normal AS ({" UNION ALL ".join(f"SELECT v{m} AS vid, cx, cy, cz FROM nb" for m in range(3))}), ns AS (SELECT vid, sum(cx) AS cx, sum(cy) AS cy, sum(cz) AS cz FROM corner_normal GROUP BY vid),
nv AS (SELECT vid, {", ".join(f"CASE WHEN cx * cx + cy * cy + cz * cz > 0 THEN c{a} / sqrt(cx * cx + cy * cy + cz * cz) ELSE 0.0 END AS n{a}" for a in AXES)} FROM ns),
wide AS (SELECT t.*, {", ".join(f"n{m}.n{a} AS n{a}{m}" for m in range(3) for a in AXES)} FROM nb b JOIN tris t USING (face_id) JOIN nv n0 ON n0.vid = b.v0 JOIN nv n1 ON n1.vid = b.v1 JOIN nv n2 ON n2.vid = b.v2),
seen AS (SELECT cam_idx, {", ".join(f"{mixed(f'{a}# + 0.5')} AS {c}, {mixed(f'n{a}#')} AS n{a}" for a, c in zip(AXES, "rgb", strict=True))} FROM best JOIN wide USING (face_id) WHERE n = 1),
shade AS (SELECT *, greatest(0.0, least(1.0, 0.3 + 0.7 * greatest(0.0, CASE WHEN nx * nx + ny * ny + nz * nz > 0 THEN (0.3 * nx - 0.5 * ny + 0.8 * nz) / sqrt(0.98::DOUBLE) / sqrt(nx * nx + ny * ny + nz * nz) ELSE 0 END))) AS light FROM seen)
SELECT c.cam_idx, {", ".join(f"round((coalesce(sum({x} * light), 0) + {W * H} - count(light)) / {W * H}, 5) AS {x}" for x in "rgb")} FROM cams c LEFT JOIN shade s USING (cam_idx) GROUP BY c.cam_idx"""


def slope(pixel: str, size: int) -> str:
    return f"(({pixel}) - {size / 2}) / {FX}"


#: Limits of the place along the camera's axes, then the sideways places by halving.
PLACES = f"""WITH RECURSIVE {points("2.0")}, {cameras("2.5", "0.3")}, lim AS (SELECT {slope("10", W)} AS kl, {slope(f"{W} - 11", W)} AS kr, {slope("10", H)} AS kb, {slope(f"{H} - 11", H)} AS kt),
box AS (SELECT greatest(1.0, max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS size FROM pts),
along AS (SELECT cam_idx, r00 * x + r01 * y + r02 * z AS a, r10 * x + r11 * y + r12 * z AS b, -(r20 * x + r21 * y + r22 * z) AS s FROM pts, cams),
ahead AS (SELECT cam_idx, least(min(s) - 1e-9 * any_value(size), (min(a - kl * s) - max(a - kr * s)) / any_value(kr - kl), (min(b - kb * s) - max(b - kt * s)) / any_value(kt - kb)) AS cf FROM along, lim, box GROUP BY cam_idx),
side AS (SELECT cam_idx, 0 AS axis, a, s - cf AS d, kl AS lo, kr AS hi FROM along JOIN ahead USING (cam_idx), lim UNION ALL SELECT cam_idx, 1, b, s - cf, kb, kt FROM along JOIN ahead USING (cam_idx), lim),
span AS (SELECT cam_idx, axis, max(a - hi * d) AS l, min(a - lo * d) AS h, any_value(lo + hi) AS aim FROM side GROUP BY ALL),
step AS (SELECT 0 AS n, cam_idx, axis, l, h, aim, h - l > 1e-6 * size AS free FROM span, box UNION ALL
  SELECT n + 1, t.cam_idx, t.axis, CASE WHEN free AND min((a - (l + h) / 2) / d) + max((a - (l + h) / 2) / d) > aim THEN (l + h) / 2 ELSE l END, CASE WHEN free AND min((a - (l + h) / 2) / d) + max((a - (l + h) / 2) / d) <= aim THEN (l + h) / 2 ELSE h END, aim, free
  FROM step t JOIN side e ON e.cam_idx = t.cam_idx AND e.axis = t.axis WHERE n < 50 GROUP BY n, t.cam_idx, t.axis, l, h, aim, free),
found AS (SELECT cam_idx, max((l + h) / 2) FILTER (WHERE axis = 0) AS cr, max((l + h) / 2) FILTER (WHERE axis = 1) AS cu FROM step WHERE n = 50 GROUP BY cam_idx)
SELECT cam_idx, {", ".join(r5(f"cr * r0{i} + cu * r1{i} - cf * r2{i}", f"p{a}") for i, a in enumerate(AXES))} FROM found JOIN ahead USING (cam_idx) JOIN cams USING (cam_idx)"""

SQL: dict[str, str] = {
    "point_neighbours": f"WITH {NEAR} SELECT id, rank, near_id, {r6('far2', 'far2')} FROM ranked WHERE rank <= 5",
    "point_normals": f"WITH {NEAR}, {THIN} SELECT id, {', '.join(f'round(s * n{a} / n, 3) AS n{a}' for a in AXES)} FROM signed",
    "price_quantiles": "SELECT l_returnflag, l_linestatus, " + ", ".join(f"round(quantile_cont(l_extendedprice::DOUBLE, {s}), 4) AS {n}" for n, s in (("least", 0.0), ("third", 1 / 3), ("median", 0.5), ("p95", 0.95), ("most", 1.0))) + " FROM lineitem GROUP BY ALL",
    "mesh_winding": WINDING,
    "textured_faces": TEXTURED,
    "lit_vertex_colors": LIT,
    "camera_resection": f"WITH {cameras('1.2', '0.3')} SELECT cam_idx, 60.0::DOUBLE AS fovx, " + ", ".join(f"round({e}, 4) + 0.0 AS m{i}{j}" for i in range(3) for j, e in enumerate((f"r{i}0", f"r{i}1", f"r{i}2", f"t{i}"))) + " FROM cams",
    "best_camera_places": PLACES,
}
