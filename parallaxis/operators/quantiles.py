"""Exact order statistics of all groups at once, by histograms that close in on them.

Every wanted place of every group has an interval of values that must hold it, at first the group's whole range. One aggregate
counts each interval's rows in equal buckets, with their least and greatest value; the bucket that holds the place is the next
interval. A few rounds leave intervals of one value or of few rows, and only these rows are sorted. No group is ever sorted or
collected whole, however many rows it has, and counts are summed per task before they are shuffled.

Rows: values that are null or not finite take no part; groups without any other have no statistics. A null group is a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import kept
from . import small
from .filters import finite

#: Buckets of an interval in a round, and rows of an interval that are sorted.
BUCKETS, SORTED_ROWS = 4096, 2048


def places(rows: DataFrame, groups: Sequence[str], value: str, wanted: DataFrame) -> DataFrame:
    """(*groups, place, value): the value at each place (from 0, in rising order) of wanted (*groups, place). rows is read in
    every round, so a written table is best."""
    groups = list(groups)
    keys = [f"g{i}" for i in range(len(groups))]
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    slim = rows.select(*[F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)], F.col(value).cast("double").alias("value")).where(finite("value"))
    whole = slim.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n"))
    asked = wanted.select(*[F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)], "place").distinct()
    on = same("a", "w") if keys else [F.lit(True)]
    now = whole.alias("w").join(asked.alias("a"), on).select(*[F.col(f"w.{k}") for k in keys], "place", F.col("place").alias("k"), "lo", "hi", "n")
    now, closed = kept(now.where("k between 0 and n - 1"), "intervals"), []
    within = lambda state: slim.alias("r").join(small(state).alias("s"), [*same("r", "s"), F.col("r.value").between(F.col("s.lo"), F.col("s.hi"))]).select(*[F.col(f"s.{k}") for k in keys], "place", "k", "lo", "hi", "value")
    one = [*keys, "place"]
    while True:
        wide = (F.col("n") > SORTED_ROWS) & (F.col("lo") < F.col("hi"))
        closed.append(now.where(~wide))
        now = now.where(wide)
        if now.isEmpty():
            break
        bucket = F.least(F.lit(BUCKETS - 1), F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS).cast("int"))
        counts = within(now).groupBy(*one, "k", bucket.alias("bucket")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n"))
        before = F.sum("n").over(Window.partitionBy(*one).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        held = counts.withColumn("before", F.coalesce(before, F.lit(0))).where("before <= k and k < before + n")
        now = kept(held.select(*one, (F.col("k") - F.col("before")).alias("k"), "lo", "hi", "n"), "intervals")
    ends = closed[0]
    for more in closed[1:]:
        ends = ends.unionByName(more)
    sure = ends.where("lo = hi").select(*one, F.col("lo").alias("value"))
    order = Window.partitionBy(*one).orderBy("value")
    rest = within(ends.where("lo < hi")).withColumn("at", F.row_number().over(order) - 1).where("at = k").select(*one, "value")
    return sure.unionByName(rest).select(*[F.col(k).alias(g) for g, k in zip(groups, keys, strict=True)], "place", "value")


def quantiles(rows: DataFrame, groups: Sequence[str], value: str, shares: dict[str, float], lower: bool = False) -> DataFrame:
    """(*groups, one column a share): the value at share * (n - 1) of each group; between two places both are weighed, or the
    lower one is taken."""
    groups = list(groups)
    table = kept(rows.select(*groups, F.col(value).cast("double").alias("_value")).where(finite("_value")), "values")
    sizes = table.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n")).where("_n > 0")
    stops = F.array(*[F.struct(F.lit(n).alias("name"), (F.lit(float(s)) * (F.col("_n") - 1)).alias("at")) for n, s in shares.items()])
    asked = kept(sizes.withColumn("_s", F.explode(stops)).select(*groups, F.col("_s.name").alias("name"), F.col("_s.at").alias("at")), "asked")
    wanted = asked.withColumn("place", F.explode(F.array(F.floor("at").cast("long"), (F.floor("at") if lower else F.ceil("at")).cast("long"))))
    found = places(table, groups, "_value", wanted.select(*groups, "place"))
    same = [F.col(f"a.{g}").eqNullSafe(F.col(f"f.{g}")) for g in groups]
    part = asked.alias("a").join(found.alias("f"), [*same, F.col("f.place").isin(F.floor("a.at"), F.ceil("a.at"))])
    share = F.col("at") - F.floor("at")
    low = F.max(F.when(F.col("place") == F.floor("at"), F.col("value")))
    high = F.max(F.when(F.col("place") == F.ceil("at"), F.col("value")))
    value_at = low if lower else low + (high - low) * F.max(share)
    each = part.groupBy(*[F.col(f"a.{g}").alias(g) for g in groups], F.col("a.name").alias("name")).agg(value_at.alias("v"))
    return each.groupBy(*groups).agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in shares])
