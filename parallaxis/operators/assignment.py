"""Least-cost one-to-one assignment, scene by scene, by prices and pruning.

References have prices. Candidates without a reference bid for the one that is cheapest to them, by as much as it is better than
their next choice and a step more; a reference takes its highest bid. Any prices bound the least cost from below, any assignment
bounds it from above, and a pair whose reduced cost is more than what lies between both bounds is in no least assignment. These
pairs are left, and the rest falls apart: candidates and references that no chain of pairs connects are assigned apart, by
shortest augmenting paths, exactly. Where every candidate's cheapest reference is another one, that is the answer at once.

So no scene is ever one group unless its costs do not tell its pairs apart, and bids, prices and pairs are rows throughout.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import send
from ..storage import kept
from .winding import parts

#: Rounds of bids; more make what is left to be assigned exactly smaller.
ROUNDS = 12


def checked(costs: DataFrame, scene: str) -> DataFrame:
    """(scene, n) of costs that name every pair of equally many candidates and references once."""
    sound = F.col("cost").isNotNull() & (F.abs("cost") < float("inf"))
    sizes = costs.groupBy(scene).agg(F.count_distinct("c_idx").alias("n"), F.count_distinct("r_idx").alias("m"), F.count(F.lit(1)).alias("pairs"), F.count_if(sound).alias("sound"), F.count_distinct("c_idx", "r_idx").alias("different"))
    sizes = kept(sizes, "sizes")
    if not sizes.where("n <> m or pairs <> n * n or sound <> pairs or different <> pairs").isEmpty():
        raise ValueError("costs must be given for all pairs of equally many candidates and references")
    return sizes.select(scene, "n")


def cheapest(pairs: DataFrame, scene: str) -> DataFrame:
    """(scene, c_idx, r_idx, value, next): every candidate's cheapest reference, of equals the first, and the cost of its next."""
    ranked = pairs.withColumn("k", F.row_number().over(Window.partitionBy(scene, "c_idx").orderBy("value", "r_idx"))).where("k <= 2")
    first = F.max(F.when(F.col("k") == 1, F.struct("r_idx", "value")))
    return ranked.groupBy(scene, "c_idx").agg(first.alias("a"), F.max(F.when(F.col("k") == 2, F.col("value"))).alias("next")).select(scene, "c_idx", "a.r_idx", "a.value", "next")


def auction(costs: DataFrame, scene: str, sizes: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Prices (scene, r_idx, price) and owners (scene, r_idx, c_idx) after so many rounds of bids."""
    step = costs.groupBy(scene).agg((F.max("cost") - F.min("cost")).alias("range")).join(sizes, scene).select(scene, F.greatest(F.col("range") / (8 * F.col("n")), F.lit(1e-12)).alias("step"))
    step = kept(step, "steps")
    state = kept(costs.select(scene, "r_idx").distinct().withColumns({"price": F.lit(0.0), "owner": F.lit(None).cast("int")}), "prices")
    for _ in range(rounds):
        idle = costs.join(state.where("owner is not null").select(scene, F.col("owner").alias("c_idx")), [scene, "c_idx"], "left_anti")
        valued = idle.join(state.select(scene, "r_idx", "price"), [scene, "r_idx"]).withColumn("value", F.col("cost") + F.col("price"))
        bids = cheapest(valued, scene).join(step, scene).withColumn("more", F.coalesce(F.col("next") - F.col("value"), F.lit(0.0)) + F.col("step"))
        won = bids.groupBy(scene, "r_idx").agg(F.max(F.struct("more", (-F.col("c_idx")).alias("order"), "c_idx")).alias("w"))
        merged = state.join(won, [scene, "r_idx"], "left")
        after = merged.select(scene, "r_idx", (F.col("price") + F.coalesce("w.more", F.lit(0.0))).alias("price"), F.coalesce("w.c_idx", "owner").cast("int").alias("owner"), F.col("w").isNotNull().alias("moved"))
        after = kept(after, "prices")
        state = after.drop("moved")
        if after.where("moved").isEmpty():
            break
    return state.select(scene, "r_idx", "price"), state.where("owner is not null").select(scene, "r_idx", F.col("owner").alias("c_idx"))


def completed(owners: DataFrame, costs: DataFrame, scene: str) -> DataFrame:
    """The owners, and those that are left on both sides one after the other."""
    rest = lambda side: costs.select(scene, side).distinct().join(owners.select(scene, side), [scene, side], "left_anti").withColumn("k", F.row_number().over(Window.partitionBy(scene).orderBy(side)))
    return owners.select(scene, "c_idx", "r_idx").unionByName(rest("c_idx").join(rest("r_idx"), [scene, "k"]).select(scene, "c_idx", "r_idx"))


def candidates(costs: DataFrame, scene: str, sizes: DataFrame, rounds: int) -> DataFrame:
    """The pairs that may be in a least assignment."""
    prices, owners = auction(costs, scene, sizes, rounds)
    valued = costs.join(prices, [scene, "r_idx"]).withColumn("value", F.col("cost") + F.col("price"))
    least = kept(valued.groupBy(scene, "c_idx").agg(F.min("value").alias("least")), "least")
    below = least.groupBy(scene).agg(F.sum("least").alias("below")).join(prices.groupBy(scene).agg(F.sum("price").alias("prices")), scene)
    above = completed(owners, costs, scene).join(costs, [scene, "c_idx", "r_idx"]).groupBy(scene).agg(F.sum("cost").alias("above"), F.max(F.abs("cost")).alias("size"))
    between = below.join(above, scene).join(sizes, scene).select(scene, (F.col("above") - F.col("below") + F.col("prices") + 1e-9 * F.col("n") * (1 + F.col("size"))).alias("between"))
    return valued.join(least, [scene, "c_idx"]).join(between, scene).where(F.col("value") - F.col("least") <= F.col("between")).select(scene, "c_idx", "r_idx", "cost")


def solve(table: np.ndarray) -> np.ndarray:
    """The row of every column in a least-cost assignment; pairs that may not be are infinite. Rows come in one by one and take
    the shortest way, in reduced costs, to a free column."""
    n = len(table)
    row_of, price = np.full(n, -1), np.zeros(n)
    for first in range(n):
        far, came, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
        row, column, base = first, -1, 0.0
        while row >= 0:
            reduced = table[row] - price
            reduced = reduced - (reduced[column] if column >= 0 else reduced.min()) + base
            closer = ~done & (reduced < far)
            far[closer], came[closer] = reduced[closer], column
            column = int(np.where(done, np.inf, far).argmin())
            base, done[column] = far[column], True
            row = row_of[column]
        price[done] += far[done] - base
        while column >= 0:
            before = came[column]
            row_of[column] = row_of[before] if before >= 0 else first
            column = before
    return row_of


def assign(costs: DataFrame, scene: str = "scene", rounds: int = ROUNDS) -> DataFrame:
    """(scene, c_idx, r_idx, cost): an assignment of the least total cost in every scene, of costs (scene, c_idx, r_idx, cost) of
    all pairs of equally many candidates and references."""
    send(costs.sparkSession)
    costs = kept(costs.select(scene, "c_idx", "r_idx", "cost"), "costs")
    sizes = checked(costs, scene)
    picks = kept(cheapest(costs.withColumn("value", F.col("cost")), scene).select(scene, "c_idx", "r_idx", F.col("value").alias("cost")), "picks")
    clear = kept(picks.groupBy(scene).agg(F.count_distinct("r_idx").alias("m")).join(sizes, scene).where("m = n").select(scene), "clear")
    sure, open_ = picks.join(clear, scene, "left_semi"), costs.join(clear, scene, "left_anti")
    if open_.isEmpty():
        return sure
    pairs = kept(candidates(kept(open_, "open"), scene, sizes, rounds), "candidates")
    side = lambda k, idx: F.struct(F.col(scene).alias("scene"), F.lit(k).alias("side"), F.col(idx).cast("long").alias("idx"))
    links = pairs.select(side(0, "c_idx").alias("a"), side(1, "r_idx").alias("b"), F.lit(0).alias("odd"))
    nodes = links.select(F.col("a").alias("face_id")).unionByName(links.select(F.col("b").alias("face_id"))).distinct()
    part = parts(nodes, links).where("face_id.side = 0").select(F.col("face_id.scene").alias(scene), F.col("face_id.idx").cast("int").alias("c_idx"), "part")
    kinds = dict(costs.dtypes)

    def exact(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot(index="c_idx", columns="r_idx", values="cost").sort_index().sort_index(axis=1)
        a = table.fillna(np.inf).to_numpy()
        rows = solve(a)
        return pd.DataFrame({scene: pdf[scene].iloc[0], "c_idx": table.index[rows], "r_idx": table.columns, "cost": a[rows, np.arange(len(a))]})

    grouped = pairs.join(part, [scene, "c_idx"])
    found = grouped.groupBy("part").applyInPandas(exact, f"{scene} {kinds[scene]}, c_idx {kinds['c_idx']}, r_idx {kinds['r_idx']}, cost double")
    return sure.unionByName(found)
