"""Connected components as Spark joins: alternating large-star and small-star
steps until nothing changes, each step's edges written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _least(edges: DataFrame) -> DataFrame:
    """(u, v) with the least node among each u and its neighbours. Only minima
    are aggregated (on the map side first); no neighbourhood is gathered. The
    table is written, so that the join with it deals both sides anew and a hot
    node's edges can be split among tasks."""
    return common.written(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")


def components(edges: DataFrame, steps: int = 60) -> DataFrame:
    """(node, component: the least node reachable) for all nodes of the edges
    (u, v). Isolated nodes are not listed. An empty edge table gives no rows."""
    now = common.written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                         .distinct(), "edges")
    state = None
    for _ in range(steps):
        # large-star: each larger neighbour of u is linked to u's least neighbour
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small-star: u and its smaller neighbours are linked to the least of them
        low = common.written(large.where("u > v"), "large-star")
        met = low.join(_least(low), "u")
        small = (met.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(met.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = common.written(small, "edges")
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components: not settled after {steps} steps")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
