"""Cameras from points and their places in the image: pose and focal length of each camera from sums over its pairs.

The linear start solves the normal equations of a camera matrix, or of a homography where the points lie in a plane; the
refinement takes damped Gauss-Newton steps. Spark sums the equations for all cameras at once, numpy finishes each camera's few
numbers. A round of refinement is one aggregate over the pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as v
from ..shipping import send
from . import small
from .align import nearest_rotation
from .filters import finite

LEAST_PAIRS = 6
#: Share of the greatest variance below which the least one is none; cost of a point behind the camera.
FLAT, BEHIND = 1e-9, 1e12
HOMOGENEOUS = ("x", "y", "z", "w")
FOUND = "cam_idx int, pose array<double>, stretch double"


def _turn(w: np.ndarray) -> np.ndarray:
    """The rotation by a vector's length about it."""
    a = np.linalg.norm(w)
    if a < 1e-12:
        return np.eye(3)
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]]) / a
    return np.eye(3) + np.sin(a) * k + (1 - np.cos(a)) * k @ k


def _spatial(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Rotation, translation and stretch of the focal length from the linear equations a d = x, b d = y of the three rows x, y
    and d (depth) of a camera matrix."""
    zero = np.zeros((4, 4))
    whole = np.block([[m["one"], zero, -m["a"]], [zero, m["one"], -m["b"]], [-m["a"], -m["b"], m["ab"]]])
    p = np.linalg.eigh(whole)[1][:, 0].reshape(3, 4)
    size = np.linalg.norm(p[2, :3])
    if size < 1e-12:
        return None
    p = p / size * (1 if p[2] @ m["one"][:, 3] > 0 else -1)
    stretch = (np.linalg.norm(p[0, :3]) + np.linalg.norm(p[1, :3])) / 2
    rot = nearest_rotation(np.stack([p[0, :3] / stretch, p[1, :3] / stretch, -p[2, :3]]))
    return rot, np.array([p[0, 3] / stretch, p[1, 3] / stretch, -p[2, 3]]), float(stretch)


def _planar(m: dict[str, np.ndarray], mean: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, float] | None:
    """The same for points in a plane through the mean: the homography from the plane's two axes (columns) to the image. The sums
    over places in the plane follow from those over places in space."""
    down = np.vstack([np.column_stack([axes[:, :2].T, -axes[:, :2].T @ mean]), [0, 0, 0, 1]])
    m = {k: down @ x @ down.T for k, x in m.items()}
    zero = np.zeros((3, 3))
    whole = np.block([[m["one"], zero, -m["a"]], [zero, m["one"], -m["b"]], [-m["a"], -m["b"], m["ab"]]])
    h = np.linalg.eigh(whole)[1][:, 0].reshape(3, 3)
    h = h * (1 if h[2] @ m["one"][:, 2] > 0 else -1)
    # both axes stay at a right angle and of one length: each says what the stretch is, unless the plane faces the camera
    p = np.array([h[0, 0] * h[0, 1] + h[1, 0] * h[1, 1], h[0, 0] ** 2 + h[1, 0] ** 2 - h[0, 1] ** 2 - h[1, 1] ** 2])
    q = np.array([h[2, 0] * h[2, 1], h[2, 0] ** 2 - h[2, 1] ** 2])
    inverse = -(p @ q) / (p @ p) if p @ p > 1e-12 * (h * h).sum() ** 2 else 1.0
    stretch = 1 / np.sqrt(inverse) if 0.01 < inverse < 100 else 1.0
    h = h / np.array([[stretch], [stretch], [-1.0]])
    size = (np.linalg.norm(h[:, 0]) + np.linalg.norm(h[:, 1])) / 2
    if size < 1e-12:
        return None
    one, two, shift = h.T / size
    turn = np.column_stack((one, two, np.cross(one, two))) @ np.column_stack((axes[:, :2], np.cross(axes[:, 0], axes[:, 1]))).T
    rot = nearest_rotation(turn)
    return rot, shift - rot @ mean, float(stretch)


def _start(sums: DataFrame) -> DataFrame:
    """Pose (3x4, row-major) and stretch of the focal length. Points that span space give all of a camera matrix, points in a
    plane a homography; points in a line leave the camera open and it drops out."""

    def solve(batches):
        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                m = {k: np.array([[r[f"{k}_{min(i, j)}{max(i, j)}"] for j in range(4)] for i in range(4)], float) for k in ("one", "a", "b", "ab")}
                mean = m["one"][:3, 3] / m["one"][3, 3]
                values, axes = np.linalg.eigh(m["one"][:3, :3] / m["one"][3, 3] - np.outer(mean, mean))
                axes, least = axes[:, ::-1], FLAT * values[2] + 1e-14 * (mean @ mean)
                if values[1] <= least:
                    continue
                found = _planar(m, mean, axes) if values[0] <= least else _spatial(m)
                if found:
                    rot, shift, stretch = found
                    out.append((int(r["cam_idx"]), np.column_stack((rot, shift)).ravel().tolist(), stretch))
            yield pd.DataFrame(out, columns=["cam_idx", "pose", "stretch"])

    return sums.mapInPandas(solve, FOUND)


def _measured(rows: DataFrame) -> DataFrame:
    """Of each camera's pose on trial: its cost (squared pixel residuals; a point behind the camera costs more than any before
    it), and the sums of a Gauss-Newton step."""
    p = v.matrix("pose", 4)[:3]
    turned = [p[i][0] * F.col("x") + p[i][1] * F.col("y") + p[i][2] * F.col("z") for i in range(3)]
    rows = rows.withColumns({f"q{a}": t for a, t in zip("xyz", turned, strict=True)} | {f"s{a}": t + p[i][3] for i, (a, t) in enumerate(zip("xyz", turned, strict=True))})
    ahead = -F.col("sz") > 1e-9
    rows = rows.withColumn("d", F.when(ahead, -F.col("sz")))
    f = F.col("fx") * F.col("stretch")
    # how the place in the camera's frame moves with a turn about each axis, and with a shift
    moves = {0: (F.lit(0.0), -F.col("qz"), F.col("qy")), 1: (F.col("qz"), F.lit(0.0), -F.col("qx")), 2: (-F.col("qy"), F.col("qx"), F.lit(0.0)), **{3 + i: tuple(F.lit(float(i == k)) for k in range(3)) for i in range(3)}}
    columns = {}
    for axis, s in (("a", "sx"), ("b", "sy")):
        for k, m in moves.items():
            columns[f"{axis}{k}"] = f * (m[0 if axis == "a" else 1] / F.col("d") + F.col(s) * m[2] / (F.col("d") * F.col("d")))
        columns[f"{axis}6"] = F.col("fx") * F.col(s) / F.col("d")
        columns[f"{axis}_r"] = f * F.col(s) / F.col("d") - F.col("fx") * F.col(axis)  # projected less seen, in pixels
    rows = rows.withColumns(columns)
    both = lambda x, y: F.coalesce(F.sum(F.col(f"a{x}") * F.col(f"a{y}") + F.col(f"b{x}") * F.col(f"b{y}")), F.lit(0.0))
    cost = F.sum(F.coalesce(F.col("a_r") ** 2 + F.col("b_r") ** 2, F.lit(BEHIND))).alias("cost")
    return rows.groupBy("cam_idx").agg(F.first("fx").alias("fx"), cost, F.array(*[both(i, j) for i in range(7) for j in range(i, 7)]).alias("h"), F.array(*[both(i, "_r") for i in range(7)]).alias("g"))


STATE = "cam_idx int, pose array<double>, stretch double, best array<double>, best_stretch double, best_cost double, best_h array<double>, best_g array<double>, damping double"


def _step(rows: DataFrame, state: DataFrame, focal_weight: float) -> DataFrame:
    """One damped step of all cameras, the focal length held near the one given. A trial that costs no more than the best so far
    becomes the best; the next trial starts from the best, the more carefully the more trials failed."""
    measured = _measured(rows.join(small(state.select("cam_idx", "pose", "stretch")), "cam_idx")).join(small(state), "cam_idx")
    at = [(i, j) for i in range(7) for j in range(i, 7)]

    def solve(batches):
        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                cost = r["cost"] + focal_weight * (r["fx"] * (r["stretch"] - 1)) ** 2
                better = np.isfinite(cost) and cost <= r["best_cost"]
                best = (r["pose"], r["stretch"], cost, r["h"], r["g"]) if better else tuple(r[k] for k in ("best", "best_stretch", "best_cost", "best_h", "best_g"))
                damping = max(1e-12, r["damping"] / 10) if better else min(1e6, max(1e-6, r["damping"] * 100))
                h, g = np.zeros((7, 7)), np.array(best[4], float)
                for (i, j), x in zip(at, best[3], strict=True):
                    h[i, j] = h[j, i] = x
                h[6, 6] += focal_weight * r["fx"] ** 2
                g[6] += focal_weight * r["fx"] ** 2 * (best[1] - 1)
                h += damping * np.diag(np.diag(h)) + 1e-12 * np.trace(h) * np.eye(7)
                step = -np.linalg.lstsq(h, g, rcond=None)[0]
                m = np.asarray(best[0], float).reshape(3, 4)
                trial = np.column_stack((_turn(step[:3]) @ m[:, :3], m[:, 3] + step[3:6])).ravel().tolist()
                out.append((int(r["cam_idx"]), trial, float(best[1] + step[6]), *[list(map(float, x)) if np.ndim(x) else float(x) for x in best], damping))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in STATE.split(", ")])

    return measured.mapInPandas(solve, STATE)


def resection(pairs: DataFrame, cameras: DataFrame, rounds: int = 10, focal_weight: float = 0.01) -> DataFrame:
    """Cameras with the pose and field of view under which their points fall where they are seen. pairs: (cam_idx, x, y, z, u, v);
    cameras: size, principal point and a field of view to start from, which stays near by focal_weight. Pairs with a null or not
    finite number take no part. Cameras with fewer than six others, or whose points lie in a line, drop out."""
    from ..functions import camera as c
    from ..storage import kept

    send(pairs.sparkSession)
    views = cameras.withColumn("fx", c.fx()).select("cam_idx", "fx", "width", "height", "cx", "cy")
    rows = pairs.where(finite("x", "y", "z", "u", "v")).select("cam_idx", "x", "y", "z", "u", "v").join(small(views), "cam_idx")
    rows = rows.withColumns({"a": (F.col("u") * F.col("width") - 0.5 - F.col("cx")) / F.col("fx"), "b": (F.col("v") * F.col("height") - 0.5 - F.col("cy")) / F.col("fx")})
    rows = kept(rows.select("cam_idx", "x", "y", "z", "a", "b", "fx"), "pairs")
    weights = {"one": F.lit(1.0), "a": F.col("a"), "b": F.col("b"), "ab": F.col("a") ** 2 + F.col("b") ** 2}
    unit = rows.withColumn("w", F.lit(1.0))
    sums = unit.groupBy("cam_idx").agg(F.count(F.lit(1)).alias("n"), *[F.sum(weight * F.col(HOMOGENEOUS[i]) * F.col(HOMOGENEOUS[j])).alias(f"{k}_{i}{j}") for k, weight in weights.items() for i in range(4) for j in range(i, 4)])
    start = _start(sums.where(F.col("n") >= LEAST_PAIRS))
    none = {"best": F.col("pose"), "best_stretch": F.col("stretch"), "best_cost": F.lit(float("inf")), "best_h": F.array_repeat(F.lit(0.0), 28), "best_g": F.array_repeat(F.lit(0.0), 7), "damping": F.lit(1e-3)}
    now = kept(start.withColumns(none), "poses")
    for _ in range(rounds + 1):  # the last trial's turn says whether it is the best
        now = kept(_step(rows, now, focal_weight), "poses")
    p = v.matrix("best", 4)[:3]
    last = [F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    found = cameras.join(small(now.select("cam_idx", "best", "best_stretch")), "cam_idx").withColumn("fx", c.fx() * F.col("best_stretch"))
    return found.withColumns({"w2c": v.flat([*p, last]), "fovx_deg": c.fovx_of(F.col("fx"), F.col("width")), "fovy_deg": F.lit(None).cast("double")}).select(*cameras.columns)
