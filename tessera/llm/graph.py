"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _is_done(edges: DataFrame) -> bool:
    """Every u has one v, and no v is a u: each component is a star around its least id."""
    roles = edges.select(F.col("u").alias("node"), F.lit(1).alias("as_u"), F.lit(0).alias("as_v")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("as_u"), F.lit(1).alias("as_v")))
    return roles.groupBy("node").agg(F.sum("as_u").alias("as_u"), F.max("as_v").alias("as_v")).filter("as_u > 1 or (as_u > 0 and as_v > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of comparable ids -> (node, root): every node that has an edge, and the least id of its component.

    Each step points neighbours at the least id around a node: minima are pre-aggregated and joined back, so a hub's
    neighbours are never in one task. The table of edges never grows, and the rounds are logarithmic in a component's size.
    Only the result stays in the shared folder."""
    with common.Scratch(edges.sparkSession) as keep:
        e = keep(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        while not _is_done(e):
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
            large = keep(large, "large")
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u")
            small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
            e = keep(small, "edges")
        stars = e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        return common.materialize(stars, "roots")
