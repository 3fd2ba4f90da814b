"""Connected components by alternating large and small stars; links never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, written


def smallest(edges: DataFrame) -> DataFrame:
    """u, v and m, the smallest of u and its neighbours. The minimum is combined before its exchange; a node with very
    many links is split by the adaptive join, as both sides are read from tables."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(low.select("u", F.least("u", "m").alias("m")), "u")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component, its smallest node, of every node in ``links`` (u, v). Any orderable type will do.

    Self links, repeated links and either direction are fine; a node with links only to itself has no row.
    """
    now = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    known = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        small = smallest(large)
        after = written(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "small")
        release(now, large)
        now = after
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == known:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        known = state
    raise RuntimeError("components didn't settle")
