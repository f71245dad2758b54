"""The widest angle between two directions of a scene, without meeting all pairs.

Directions are cells of the cube around the unit sphere, each with the box of its directions and one of them. Two cells' boxes
bound the angle between their directions, two cells' own directions give one that is reached. Pairs of cells that cannot reach
the best met so far are left; the others' cells are halved along each axis, until what is left are few pairs of directions.
Equal directions count once. The loop has at most DEEPEST turns.

Rows: directions that are null or not finite take no part. Scenes of fewer than two other directions have the angle 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vector as v
from ..storage import kept
from . import small
from .filters import AXES, finite

FIRST, DEEPEST = 2, 20
#: Pairs of directions a direction that are met in the end.
PAIRS_EACH, PAIRS_LEAST = 64, 100_000
SLACK = 1e-12


def _code(level: int) -> Column:
    n = 1 << level
    at = [F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(a) + 1) / 2 * n))).cast("long") for a in AXES]
    return (at[0] * n + at[1]) * n + at[2]


def _cells(rows: DataFrame, scene: str, level: int) -> DataFrame:
    """(scene, up: the cell one level up, cell, n, box and one direction)."""
    coded = rows.withColumns({"up": _code(level - 1), "cell": _code(level)})
    one = F.min(F.struct(*AXES)).alias("one")
    return coded.groupBy(scene, "up", "cell").agg(F.count(F.lit(1)).alias("n"), one, *[f(a).alias(f"{k}_{a}") for a in AXES for k, f in (("lo", F.min), ("hi", F.max))])


def _reach(pairs: DataFrame, scene: str) -> DataFrame:
    """Pairs of cells that may hold the widest pair of their scene."""
    apart = lambda p, q: F.greatest(F.abs(p), F.abs(q))
    most = sum((F.pow(apart(F.col(f"a.hi_{a}") - F.col(f"b.lo_{a}"), F.col(f"b.hi_{a}") - F.col(f"a.lo_{a}")), 2) for a in AXES), F.lit(0.0))
    met = sum((F.pow(F.col(f"a.one.{a}") - F.col(f"b.one.{a}"), 2) for a in AXES), F.lit(0.0))
    rated = kept(pairs.select(F.col(f"a.{scene}").alias(scene), F.col("a.cell").alias("a"), F.col("b.cell").alias("b"), (F.col("a.n") * F.col("b.n")).alias("n"), most.alias("most"), met.alias("met")), "pairs-of-cells")
    best = rated.groupBy(scene).agg(F.max("met").alias("best"))
    return kept(rated.join(small(best), scene).where(F.col("most") >= F.col("best") - SLACK).select(scene, "a", "b", "n"), "cells-in-reach")


def widest_angles(rows: DataFrame, scene: str = "scene", made: list | None = None) -> DataFrame:
    """(scene, angle_deg) of rows (scene, x, y, z: unit vectors). A list given as `made` is told the pairs of every turn."""
    one = kept(rows.where(finite(*AXES)).select(scene, *AXES).distinct(), "directions")
    total, level = one.count(), FIRST
    first = _cells(one, scene, level)
    pairs = _reach(first.alias("a").join(first.alias("b"), (F.col(f"a.{scene}") == F.col(f"b.{scene}")) & (F.col("a.cell") <= F.col("b.cell"))), scene)
    while True:
        held, cells = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        if made is not None:
            made.append(cells)
        if held <= max(PAIRS_LEAST, PAIRS_EACH * total) or level == DEEPEST:
            break
        level += 1
        sides = {p: _cells(one, scene, level).alias(p) for p in "ab"}
        own = pairs.withColumnsRenamed({"a": "pa", "b": "pb"}).alias("p")
        down = own.join(sides["a"], (F.col(f"p.{scene}") == F.col(f"a.{scene}")) & (F.col("p.pa") == F.col("a.up"))).join(sides["b"], (F.col(f"p.{scene}") == F.col(f"b.{scene}")) & (F.col("p.pb") == F.col("b.up")))
        pairs = _reach(down.where((F.col("p.pa") < F.col("p.pb")) | (F.col("a.cell") <= F.col("b.cell"))), scene)
    if made is not None:
        made.append(held)
    placed = one.withColumn("cell", _code(level))
    side = lambda p: placed.select(scene, F.col("cell").alias(p), *[F.col(a).alias(f"{p}{a}") for a in AXES])
    met = pairs.select(scene, "a", "b").join(side("a"), [scene, "a"]).join(side("b"), [scene, "b"])
    angle = v.angle_deg(v.cols(*[f"a{a}" for a in AXES]), v.cols(*[f"b{a}" for a in AXES]))
    other = F.greatest(*[F.abs(F.col(f"a{a}") - F.col(f"b{a}")) for a in AXES]) > 0
    wide = met.groupBy(scene).agg(F.max(F.when(other, angle)).alias("angle_deg"))
    return rows.select(scene).distinct().join(wide, scene, "left").withColumn("angle_deg", F.coalesce("angle_deg", F.lit(0.0)))
