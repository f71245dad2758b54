"""Connected components of an edge table by alternating large and small stars, all in Spark.

Edges with a null end and edges of a node with itself are left out; repeated and reversed edges count once. A component is
named by its smallest node, so there are no ties. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialize


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the smallest node reached) of every node of an edge; each round's edges are written out."""
    now = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u <> v").distinct(), "edges")
    while True:
        # large star: every larger neighbour is tied to the smallest neighbour
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every smaller neighbour and the node itself are tied to the smallest one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(small, "edges")
        # every node has one edge, to a node without any: stars
        heads = after.select(F.col("v").alias("u")).distinct()
        if after.groupBy("u").count().where("count > 1").isEmpty() and after.join(heads, "u", "left_semi").isEmpty():
            break
        now = after
    return after.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
