"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folium.llm._store import cut, done


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """node, component (its least node) for each node of an edge other than a loop; edges are pairs of longs."""
    now = cut(edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u != v").distinct(), "components")
    before = None
    while (state := now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()) != before and state[0]:
        before = state
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        following = cut(small.distinct(), "components")
        done(now)
        now = following
    own = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return own.union(now.select(F.col("v"), F.col("v"))).groupBy("node").agg(F.min("component").alias("component"))
