"""Exact nearest neighbours, and normals from them.

The points' cube is halved along each axis wherever a cell holds more than a few points; a query starts at the first level on
which its cell is no such cell. The ring of 27 cells around it there holds its whole parent cell, so always enough points. If
the k-th of them lies nearer than the ring's border, they are the answer; else its distance names the level whose ring must
hold the answer, and a second look ends the search. So a query meets points of its own density around it, and no pair of far
ones. Of points at one place only the k smallest ids can ever be among k neighbours; the others leave first.

Rows: points and queries with a null or not finite coordinate have and are no neighbours. Of equal distances the smaller id
comes first. With fewer than k points all are given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import kept
from .filters import AXES, finite

#: Levels that one count looks at, and the deepest level.
STRIDE, DEEPEST = 5, 40
CELL = ("i", "j", "k")


def _cell(level: Column, box: dict) -> dict[str, Column]:
    """Numbers of the cell on a level, from the one formula that all sides use."""
    return {n: F.floor((F.col(a) - F.lit(box[a])) / F.lit(box["side"]) * F.pow(F.lit(2.0), level)).cast("long") for n, a in zip(CELL, AXES, strict=True)}


def crowded_cells(points: DataFrame, box: dict, most: int) -> list[DataFrame]:
    """(level, i, j, k) of all cells that hold more than so many points: tables of STRIDE levels each, of which the next looks
    only at points in the crowded cells of the last one's deepest level."""
    out, now = [], points
    for first in range(0, DEEPEST, STRIDE):
        levels = F.sequence(F.lit(first), F.lit(first + STRIDE - 1))
        rows = now.select(*AXES, F.explode(levels).alias("level"))
        cells = kept(rows.withColumns(_cell(F.col("level"), box)).groupBy("level", *CELL).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).drop("n"), "crowded")
        out.append(cells)
        deep = cells.where(F.col("level") == first + STRIDE - 1).drop("level")
        if deep.isEmpty():
            break
        now = kept(now.withColumns(_cell(F.lit(first + STRIDE - 1), box)).join(deep, list(CELL), "left_semi").select(*AXES), "deep")
    return out


def nearest(queries: DataFrame, points: DataFrame, k: int, digits: int | None = None, keep_most: int | None = None) -> DataFrame:
    """(id, rank from 1, near_id, far2): of each query (id, x, y, z) the k nearest points (id, x, y, z), with their squared
    distances, which count as equal where they agree to so many digits. A point that is a query is its own neighbour."""
    spark = queries.sparkSession
    most = keep_most or max(2 * k, 8)
    by_place = Window.partitionBy(*AXES).orderBy("id")
    places = kept(points.where(finite(*AXES)).select("id", *AXES).withColumn("n", F.row_number().over(by_place)).where(F.col("n") <= k).drop("n"), "places")
    asked = kept(queries.where(finite(*AXES)).select("id", *AXES), "queries")
    ends = asked.select(*AXES).unionByName(places.select(*AXES)).agg(*[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))]).first()
    none = spark.createDataFrame([], f"id {dict(asked.dtypes)['id']}, rank int, near_id {dict(places.dtypes)['id']}, far2 double")
    if ends["lo_x"] is None or places.isEmpty():
        return none
    box = {a: ends[f"lo_{a}"] for a in AXES}
    box["side"] = max(ends[f"hi_{a}"] - ends[f"lo_{a}"] for a in AXES) * (1 + 1e-9) or 1.0
    crowded = crowded_cells(places, box, most)
    deepest = STRIDE * len(crowded)
    level_of = asked.select("id", *AXES, F.explode(F.sequence(F.lit(0), F.lit(deepest - 1))).alias("level")).withColumns(_cell(F.col("level"), box))
    full = crowded[0]
    for more in crowded[1:]:
        full = full.unionByName(more)
    deep = level_of.join(full, ["level", *CELL]).groupBy("id").agg((F.max("level") + 1).alias("level"))
    now = kept(asked.join(deep, "id", "left").withColumn("level", F.coalesce("level", F.lit(0))).withColumn("within", F.lit(float("inf"))), "started")
    done = []
    while True:
        used = [r["level"] for r in now.select("level").distinct().collect()]  # at most DEEPEST levels
        if not used:
            break
        sides = places.select(F.col("id").alias("near_id"), *AXES, F.explode(F.array(*[F.lit(x) for x in sorted(used)])).alias("level")).withColumns(_cell(F.col("level"), box))
        sides = sides.select("near_id", *[F.col(a).alias(f"p{a}") for a in AXES], "level", *CELL)
        own = now.withColumns(_cell(F.col("level"), box))
        edge = F.lit(box["side"]) / F.pow(F.lit(2.0), F.col("level"))
        room = F.least(*[F.least(F.col(a) - box[a] - F.col(n) * edge, F.lit(box[a]) + (F.col(n) + 1) * edge - F.col(a)) for n, a in zip(CELL, AXES, strict=True)])
        own = own.withColumn("reach", F.when(F.col("level") == 0, float("inf")).otherwise((edge + room) * (1 - 1e-9)))
        ring = own
        for n in CELL:
            ring = ring.withColumn(n, F.explode(F.array(F.col(n) - 1, F.col(n), F.col(n) + 1)))
        far2 = sum(((F.col(f"p{a}") - F.col(a)) * (F.col(f"p{a}") - F.col(a)) for a in AXES), F.lit(0.0))
        order = F.col("far2") if digits is None else F.round("far2", digits)
        met = ring.join(sides, ["level", *CELL]).withColumn("far2", far2).where("far2 <= within")
        best = met.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(order, "near_id"))).where(F.col("rank") <= k)
        best = kept(best.select("id", *AXES, "level", "reach", "rank", "near_id", "far2"), "best")
        # differences below the digits may not hide a point beyond the ring
        slack = 0.0 if digits is None else 2 * 10.0**-digits
        last = best.groupBy("id", *AXES, "level", "reach").agg(F.max("far2").alias("end"), F.count(F.lit(1)).alias("n"))
        ends_here = (F.col("level") == 0) | ((F.col("n") == k) & (F.sqrt(F.col("end") + slack) < F.col("reach")))
        last = kept(last.withColumn("ends", ends_here), "last")
        done.append(best.join(last.where("ends").select("id"), "id", "left_semi").select("id", "rank", "near_id", "far2"))
        # the coarsest level whose cells are as wide as the k-th point is far
        wide = F.floor(F.log2(F.lit(box["side"]) / F.greatest(F.sqrt(F.col("end") + slack) * (1 + 1e-9), F.lit(box["side"] * 2.0**-DEEPEST)))).cast("int")
        deeper = F.when(F.col("n") == k, F.least(wide, F.col("level") - 1)).otherwise(F.col("level") - 1)
        limit = F.when(F.col("n") == k, (F.col("end") + slack) * (1 + 1e-9)).otherwise(float("inf"))
        now = kept(last.where("not ends").select("id", *AXES, F.greatest(F.lit(0), deeper).alias("level"), limit.alias("within")), "again")
    out = none
    for part in done:
        out = out.unionByName(part)
    return out


def covariances(points: DataFrame, k: int = 30) -> DataFrame:
    """(id, n, xx, xy, xz, yy, yz, zz): covariance of each point's k nearest points, itself among them, from their means."""
    places = points.select(F.col("id").alias("near_id"), *AXES)
    near = nearest(points, points, k).join(places, "near_id")
    own = near.join(points.select("id", *[F.col(a).alias(f"o{a}") for a in AXES]), "id")
    # sums of differences from the point itself, so that far from the origin no digits are lost
    for a in AXES:
        own = own.withColumn(a, F.col(a) - F.col(f"o{a}"))
    pairs = [(a, b) for q, a in enumerate(AXES) for b in AXES[q:]]
    sums = own.groupBy("id").agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(f"m{a}") for a in AXES], *[F.avg(F.col(a) * F.col(b)).alias(a + b) for a, b in pairs])
    return sums.select("id", "n", *[(F.col(a + b) - F.col(f"m{a}") * F.col(f"m{b}")).alias(a + b) for a, b in pairs])


def estimated_normals(points: DataFrame, k: int = 30) -> DataFrame:
    """(id, nx, ny, nz): unit normal of the plane through each point's k nearest points: the direction in which they vary least.
    Its sign has no meaning; the component of greatest size is made positive. Points with fewer than three neighbours, or whose
    neighbours are all at one place, look along z."""
    names = [a + b for q, a in enumerate(AXES) for b in AXES[q:]]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            xx, xy, xz, yy, yz, zz = (pdf[n].to_numpy() for n in names)
            m = np.stack([np.stack([xx, xy, xz], -1), np.stack([xy, yy, yz], -1), np.stack([xz, yz, zz], -1)], -2)
            values, vectors = np.linalg.eigh(m)
            normal = vectors[:, :, 0]
            normal[(pdf["n"].to_numpy() < 3) | (values[:, 2] <= 0)] = (0.0, 0.0, 1.0)
            top = np.take_along_axis(normal, np.abs(normal).argmax(1)[:, None], 1)
            normal = normal * np.where(top < 0, -1.0, 1.0)
            yield pd.DataFrame({"id": pdf["id"], "nx": normal[:, 0], "ny": normal[:, 1], "nz": normal[:, 2]})

    cov = covariances(points, k)
    return cov.mapInPandas(solve, f"id {dict(cov.dtypes)['id']}, nx double, ny double, nz double")
