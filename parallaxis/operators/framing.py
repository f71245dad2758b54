"""The nearest place from which a camera, without turning, has all points in its image.

Along a camera's axes a point is (x, y, s): to the right, up, ahead. Whatever bounds the place, and every extreme of the image
from any place, is reached by points on the rim of the cloud as seen along one axis: the corners of the convex hull of (x, s),
and of (y, s). So each task reduces what it reads to those corners, camera by camera, and sends them alone; a camera's corners
of all tasks are reduced once more and give its place. The cloud is read once, whatever the number of cameras.

Rows: points with a null or not finite coordinate take no part. Cameras whose margin leaves no image, and those that no place
serves, drop out; so do all where there is no point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import camera as c
from ..functions import vector as v
from ..shipping import send
from . import small
from .filters import AXES, finite

#: Cameras that a pass over the points serves.
CAMERAS = 20_000
#: Directions in which a quick polygon is spanned before the exact hull.
DIRECTIONS = np.stack([np.cos(np.linspace(0, 2 * np.pi, 24, endpoint=False)), np.sin(np.linspace(0, 2 * np.pi, 24, endpoint=False))])


def hull_corners(at: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of places in a plane, in any order; of few places all."""
    at = np.unique(at, axis=0)
    if len(at) > 64:
        rim = at[np.unique((at @ DIRECTIONS).argmax(0))]
        if len(rim) > 2:
            middle = rim.mean(0)
            rim = rim[np.argsort(np.arctan2(*(rim - middle).T[::-1]))]
            way = np.roll(rim, -1, 0) - rim
            depth = way[:, 0] * (at[:, 1:] - rim[:, 1]) - way[:, 1] * (at[:, :1] - rim[:, 0])
            at = at[~(depth > 1e-12 * np.abs(at).max() ** 2).all(1)]
    if len(at) <= 3:
        return at
    chains = []
    for side in (at, at[::-1]):
        chain: list[np.ndarray] = []
        for p in side:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]):
                chain.pop()
            chain.append(p)
        chains += chain[:-1]
    return np.array(chains)


def centred(lines: np.ndarray, low: float, high: float, target: float) -> float:
    """Where, between low and high, the middle of the least and greatest (a - place) / d is the target; rows of lines are (a, d),
    d > 0. The middle falls as the place grows, along straight pieces: each step solves the piece it stands on."""
    a, d = lines[:, 0], lines[:, 1]

    def piece(place: float) -> tuple[float, int, int]:
        seen = (a - place) / d
        i, j = int(seen.argmin()), int(seen.argmax())
        return (seen[i] + seen[j]) / 2, i, j

    if piece(low)[0] <= target:
        return low
    if piece(high)[0] >= target:
        return high
    place = (low + high) / 2
    for _ in range(200):
        middle, i, j = piece(place)
        low, high = (place, high) if middle > target else (low, place)
        root = (a[i] / d[i] + a[j] / d[j] - 2 * target) / (1 / d[i] + 1 / d[j])
        step = root if low < root < high else (low + high) / 2
        if abs(step - place) <= 1e-15 * max(1.0, abs(place)):
            return step
        place = step
    return place


def place_of(view: dict, sides: list[np.ndarray], extent: float, margin: float) -> list[float] | None:
    """(right, up, ahead) of the place, from the camera's numbers and its corners (a, s) along both axes."""
    size = max(extent, 1.0)
    ahead, spans = min(side[:, 1].min() for side in sides) - 1e-9 * size, []
    for side, focal, principal, pixels in zip(sides, ("focal_x", "focal_y"), ("cx", "cy"), ("width", "height"), strict=True):
        near, far = margin, view[pixels] - 1.0 - margin
        slopes = (near - view[principal]) / view[focal], (far - view[principal]) / view[focal]
        if near > far or slopes[0] >= slopes[1]:
            return None
        a, s = side.T
        ahead = min(ahead, ((a - slopes[0] * s).min() - (a - slopes[1] * s).max()) / (slopes[1] - slopes[0]))
        spans.append((slopes, ((near + far) / 2 - view[principal]) / view[focal]))
    out = []
    for side, (slopes, target) in zip(sides, spans, strict=True):
        a, d = side[:, 0], side[:, 1] - ahead
        low, high = (a - slopes[1] * d).max(), (a - slopes[0] * d).min()
        if low > high + 1e-6 * size or d.min() <= 0:
            return None
        out.append((low + high) / 2 if high - low <= 1e-6 * size else centred(np.column_stack((a, d)), low, high, target))
    return [*map(float, out), float(ahead)]


def best_positions(cameras: DataFrame, points: DataFrame, margin: int = 10) -> DataFrame:
    """Cameras moved, without turning, to the nearest place from which all points fall on their image's pixels less a margin,
    and there as far aside as brings the middle of the points' box in the image nearest to the middle of what the margin
    leaves."""
    if margin < 0:
        raise ValueError(f"margin must not be negative, not {margin!r}")
    spark = points.sparkSession
    send(spark)
    cloud = points.where(finite(*AXES)).select(*[F.col(a).cast("double").alias(a) for a in AXES])
    axes = {"r": c.rotation()[0], "u": c.up(), "f": c.forward()}
    views = cameras.select("cam_idx", c.fx().alias("focal_x"), c.fy().alias("focal_y"), *[F.col(n).cast("double").alias(n) for n in ("cx", "cy", "width", "height")], *[x.alias(f"{k}{a}") for k, t in axes.items() for a, x in zip(AXES, t, strict=True)])
    ends = cloud.agg(*[f(a).alias(f"{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))]).first()
    extent = max((ends[f"hi{a}"] - ends[f"lo{a}"] for a in AXES if ends["lox"] is not None), default=0.0)

    def served(block: list[dict]) -> DataFrame:
        turns = np.array([[[r[f"{k}{a}"] for a in AXES] for k in "ruf"] for r in block])

        def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[list[np.ndarray]] = [[np.zeros((0, 2))] * 2 for _ in block]
            for pdf in batches:
                at = pdf[list(AXES)].to_numpy()
                for own, turn in zip(held, turns, strict=True):
                    x, y, s = turn @ at.T
                    own[:] = [hull_corners(np.concatenate((old, np.column_stack((a, s))))) for old, a in zip(own, (x, y), strict=True)]
            for r, own in zip(block, held, strict=True):
                for axis, side in enumerate(own):
                    yield pd.DataFrame({"cam_idx": np.full(len(side), r["cam_idx"], np.int32), "axis": np.full(len(side), axis, np.int32), "a": side[:, 0], "s": side[:, 1]})

        numbers = {r["cam_idx"]: r for r in block}

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            view = numbers[int(pdf["cam_idx"].iloc[0])]
            sides = [hull_corners(pdf.loc[pdf["axis"] == axis, ["a", "s"]].to_numpy()) for axis in (0, 1)]
            found = place_of(view, sides, extent, float(margin))
            rows = [(view["cam_idx"], *[sum(w * view[f"{k}{a}"] for w, k in zip(found, "ruf", strict=True)) for a in AXES])] if found else []
            return pd.DataFrame(rows, columns=["cam_idx", "ox", "oy", "oz"])

        return cloud.mapInPandas(corners, "cam_idx int, axis int, a double, s double").groupBy("cam_idx").applyInPandas(solve, "cam_idx int, ox double, oy double, oz double")

    found, block = spark.createDataFrame([], "cam_idx int, ox double, oy double, oz double"), []
    for r in views.toLocalIterator():
        block.append(r.asDict())
        if len(block) == CAMERAS:
            found, block = found.unionByName(served(block)), []
    if block:
        found = found.unionByName(served(block))
    rows = cameras.join(small(found), "cam_idx")
    return rows.withColumn("w2c", c.pose(c.rotation()[0], c.up(), c.rotation()[2], v.cols("ox", "oy", "oz"))).select(*cameras.columns)
