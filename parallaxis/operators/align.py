"""Alignment from distributive moments: Spark sums products per scene, a small solver finishes each scene's 3x3 problem."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import send

SOURCE, TARGET = ("x", "y", "z"), ("tx", "ty", "tz")


def moments(pairs: DataFrame, scene: str = "scene") -> DataFrame:
    """Number, sums and sums of products of paired points; one row per scene whatever its size."""
    both = (*SOURCE, *TARGET)
    sums = [F.sum(n).alias(f"s_{n}") for n in both]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for i, a in enumerate(both) for b in both[i:]]
    return pairs.groupBy(scene).agg(F.count(F.lit(1)).alias("n"), *sums, *products)


def _centred(r: pd.Series) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n, means of source and target, covariance of source with itself and with the target."""
    get = lambda a, b: r[f"p_{a}_{b}"] if f"p_{a}_{b}" in r else r[f"p_{b}_{a}"]
    n = float(r["n"])
    ms, mt = (np.array([r[f"s_{a}"] for a in side], float) / n for side in (SOURCE, TARGET))
    ss = np.array([[get(a, b) for b in SOURCE] for a in SOURCE], float) / n - np.outer(ms, ms)
    st = np.array([[get(a, b) for b in TARGET] for a in SOURCE], float) / n - np.outer(ms, mt)
    return n, ms, mt, ss, st


def nearest_rotation(m: np.ndarray) -> np.ndarray:
    u, _, vt = np.linalg.svd(m)
    return u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt)) or 1]) @ vt


def similarity(pairs: DataFrame, scene: str = "scene", rotate: bool = True, rescale: bool = True) -> DataFrame:
    """Least-squares similarity from source to target points of each scene as a row-major 4x4 matrix with its scale, null
    for too few or coinciding points."""

    def solve(batches):
        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                n, ms, mt, ss, st = _centred(r)
                if n < (3 if rotate else 2) or np.trace(ss) < 1e-8:
                    out.append((r[scene], None, None))
                    continue
                u, d, vt = np.linalg.svd(st.T)
                sign = np.array([1, 1, np.sign(np.linalg.det(u @ vt)) or 1])
                rot = u @ np.diag(sign) @ vt if rotate else np.eye(3)
                s = ((d * sign).sum() if rotate else np.trace(st)) / np.trace(ss) if rescale else 1.0
                t = np.eye(4)
                t[:3, :3], t[:3, 3] = s * rot, mt - s * rot @ ms
                out.append((r[scene], t.ravel().tolist(), float(s)))
            yield pd.DataFrame(out, columns=[scene, "transform", "scale"])

    send(pairs.sparkSession)
    kind = dict(pairs.dtypes)[scene]
    return moments(pairs, scene).mapInPandas(solve, f"{scene} {kind}, transform array<double>, scale double")


def affine(pairs: DataFrame, scene: str = "scene") -> DataFrame:
    """Least-squares linear map and shift of each scene, and the rotation nearest to the map."""

    def solve(batches):
        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                _, ms, mt, ss, st = _centred(r)
                a = (np.linalg.pinv(ss) @ st).T
                out.append((r[scene], a.ravel().tolist(), (mt - a @ ms).tolist(), nearest_rotation(a).ravel().tolist()))
            yield pd.DataFrame(out, columns=[scene, "linear", "shift", "rotation"])

    send(pairs.sparkSession)
    kind = dict(pairs.dtypes)[scene]
    return moments(pairs, scene).mapInPandas(solve, f"{scene} {kind}, linear array<double>, shift array<double>, rotation array<double>")


def focus_point(rays: DataFrame, scene: str = "scene") -> DataFrame:
    """Least-squares meeting point of rays (origin x, y, z; unit direction dx, dy, dz): sums of I - dd' and of its product
    with the origins, then one 3x3 system a scene."""
    axes = "xyz"
    p = lambda a, b: (F.lit(1.0 if a == b else 0.0) - F.col(f"d{a}") * F.col(f"d{b}"))
    sums = [F.sum(p(a, b)).alias(f"m_{a}{b}") for a in axes for b in axes]
    right = [F.sum(p(a, "x") * F.col("x") + p(a, "y") * F.col("y") + p(a, "z") * F.col("z")).alias(f"q_{a}") for a in axes]

    def solve(batches):
        for pdf in batches:
            m = pdf[[f"m_{a}{b}" for a in axes for b in axes]].to_numpy().reshape(-1, 3, 3)
            q = pdf[[f"q_{a}" for a in axes]].to_numpy()
            at = np.array([np.linalg.lstsq(a, b, rcond=None)[0] for a, b in zip(m, q, strict=True)]).reshape(-1, 3)
            yield pd.DataFrame({scene: pdf[scene], "x": at[:, 0], "y": at[:, 1], "z": at[:, 2]})

    send(rays.sparkSession)
    kind = dict(rays.dtypes)[scene]
    return rays.groupBy(scene).agg(*sums, *right).mapInPandas(solve, f"{scene} {kind}, x double, y double, z double")


def sphere(points: DataFrame, scene: str = "scene") -> DataFrame:
    """Algebraic least-squares sphere of each scene's points: centre and radius. Points in one plane have no such sphere; for
    the sphere that a rig's cameras stand on, their views count too: normalize.cameras_sphere."""
    axes = "xyz"
    sq = F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2
    terms = {"x": F.col("x"), "y": F.col("y"), "z": F.col("z"), "1": F.lit(1.0)}
    left = [F.sum(a * b).alias(f"a_{i}{j}") for i, a in terms.items() for j, b in terms.items()]
    right = [F.sum(a * sq).alias(f"b_{i}") for i, a in terms.items()]
    names = list(terms)

    def solve(batches):
        for pdf in batches:
            a = pdf[[f"a_{i}{j}" for i in names for j in names]].to_numpy().reshape(-1, 4, 4)
            b = pdf[[f"b_{i}" for i in names]].to_numpy()
            w = np.array([np.linalg.lstsq(m, q, rcond=None)[0] for m, q in zip(a, b, strict=True)]).reshape(-1, 4)
            centre = w[:, :3] / 2
            yield pd.DataFrame({scene: pdf[scene], **{n: centre[:, k] for k, n in enumerate(axes)}, "radius": np.sqrt(np.maximum(0, w[:, 3] + (centre**2).sum(1)))})

    send(points.sparkSession)
    kind = dict(points.dtypes)[scene]
    return points.groupBy(scene).agg(*left, *right).mapInPandas(solve, f"{scene} {kind}, x double, y double, z double, radius double")
