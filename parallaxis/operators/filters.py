"""Row filters on point clouds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import kept

AXES = ("x", "y", "z")


def finite(*names: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf")) for n in names])


def in_box(low: dict[str, Column | float], high: dict[str, Column | float]) -> Column:
    """Inside the box, borders included."""
    return reduce(lambda a, b: a & b, [F.col(n).between(low[n], high[n]) for n in AXES])


def box(points: DataFrame) -> DataFrame:
    return points.agg(*[f(n).alias(f"{k}_{n}") for n in AXES for k, f in (("lo", F.min), ("hi", F.max))])


def in_bounds(points: DataFrame, half: float = 0.5) -> DataFrame:
    return points.where(finite(*AXES) & in_box(dict.fromkeys(AXES, -half), dict.fromkeys(AXES, half)))


def domain_stats(points: DataFrame, half: float = 0.5) -> DataFrame:
    """How many points are finite, and how many of these lie in the cube."""
    inside = finite(*AXES) & in_box(dict.fromkeys(AXES, -half), dict.fromkeys(AXES, half))
    return points.agg(F.count_if(finite(*AXES)).alias("finite"), F.count_if(inside).alias("inside"))


def expanded_box(points: DataFrame, core: DataFrame, ratio: float) -> DataFrame:
    """Points within the core's box, padded on each side by a share of its extent."""
    b = core.agg(*[f(n).alias(f"{k}_{n}") for n in AXES for k, f in (("lo", F.min), ("hi", F.max))])
    pad = {n: (F.col(f"hi_{n}") - F.col(f"lo_{n}")) * ratio for n in AXES}
    inside = in_box({n: F.col(f"lo_{n}") - pad[n] for n in AXES}, {n: F.col(f"hi_{n}") + pad[n] for n in AXES})
    return points.join(F.broadcast(b)).where(inside).select(*points.columns)  # b is one row


def octree_core(points: DataFrame, leaf_share: float = 0.01, depths: int = 8, least_leaf: int = 1, least_points: int = 16, most_rejected: float = 0.01) -> DataFrame:
    """Points that stay in well-filled leaves at every depth of an octree over the box of those that stayed so far.

    A depth that would reject more than `most_rejected` of its points is undone and ends the search. The loop has at most
    `depths` turns; leaf counts and what stays are written out, so a turn reads its predecessor's result alone.
    """
    now = points
    for depth in range(1, depths + 1):
        n, *bounds = now.agg(F.count(F.lit(1)), *[f(a) for a in AXES for f in (F.min, F.max)]).first()
        lo, hi = dict(zip(AXES, bounds[::2], strict=True)), dict(zip(AXES, bounds[1::2], strict=True))
        if n < max(4, least_points) or max(hi[a] - lo[a] for a in AXES) <= 0:
            break
        grid = 1 << depth
        cells = [F.greatest(F.lit(0), F.least(F.lit(grid - 1), F.floor((F.col(a) - lo[a]) / (hi[a] - lo[a] or 1.0) * grid))) for a in AXES]
        leaf = (cells[0] * grid + cells[1]) * grid + cells[2]
        counts = kept(now.groupBy(leaf.alias("leaf")).agg(F.count(F.lit(1)).alias("n")), "leaves")
        top = counts.agg(F.max("n")).first()[0]
        need = max(1, least_leaf, -int(-(top * leaf_share) // 1))
        poor = counts.where(F.col("n") < need)
        rejected = poor.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if rejected / n > max(0.0, most_rejected):
            break
        if rejected:
            now = kept(now.withColumn("leaf", leaf).join(poor.select("leaf"), "leaf", "left_anti").select(*points.columns), "core")
    return now


def main_cluster(points: DataFrame, expand: float = 0.05, least_core: float = 0.5, **octree) -> DataFrame:
    """Points within the expanded box of the octree's core; all points if they are few or the core is."""
    n = points.count()
    if n < 4:
        return points
    core = kept(octree_core(points, **octree), "core")
    held = core.count()
    return points if held == 0 or held < -int(-(n * least_core) // 1) else expanded_box(points, core, expand)


def lower_quantile(df: DataFrame, group: str, value: str, share: float, name: str) -> DataFrame:
    """The order statistic at floor(share * (n - 1)) of each group's finite values: the 'lower' quantile."""
    from .quantiles import quantiles

    return quantiles(df, [group], value, {name: share}, lower=True)
