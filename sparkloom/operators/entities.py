"""Names of one thing brought together: entities near one another in their vectors become one, and relations follow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, nearby
from .history import joined_null_safe


def canonical(entities: DataFrame, bound: float, within: Sequence[str], order: str = "id", stretch: float = 1.3) -> DataFrame:
    """id and canonical, the first by ``order`` then id of those that are one thing with it.

    ``entities`` has id, name, vector, aliases (a list of names, may be null) and the columns ``within`` which entities must
    agree, such as their type and owner. Two are one thing if their distance is at most ``bound``, or at most ``stretch``
    times that and one has the other's name (in any case, without space around) among its aliases; and so on from one to
    the next. Equal vectors are one node, aliases meet names by an equal join, so no pairs of a group are listed. An entity
    without a vector stays itself.
    """
    nodes, members = nearby.nodes_of(entities, "id", "vector", within)
    close = graph.persisted(nearby.close_pairs(nodes, bound * stretch, within))
    named = entities.join(members.select("id", "node"), "id")
    plain = lambda c: F.lower(F.trim(c))
    told = named.select(*within, F.col("node").alias("a"), F.explode("aliases").alias("alias")).withColumn("alias", plain(F.col("alias"))).where("alias <> ''").distinct()
    has = named.select(*within, F.col("node").alias("b"), plain(F.col("name")).alias("alias")).distinct()
    evidence = joined_null_safe(told, has, [*within, "alias"]).where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    ordered = close.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "distance")
    links = ordered.where(F.col("distance") <= bound).select("u", "v").unionByName(ordered.where(F.col("distance") > bound).join(evidence, ["u", "v"]).select("u", "v"))
    found = graph.components(nodes.select("node"), links)
    placed = named.select("id", "node", order if order != "id" else F.col("id").alias("_order")).join(found, "node")
    by = "_order" if order == "id" else order
    first = placed.groupBy("component").agg(F.min_by("id", F.struct(by, "id")).alias("canonical"))
    return entities.select("id").join(placed.join(first, "component").select("id", "canonical"), "id", "left").select("id", F.coalesce("canonical", "id").alias("canonical"))


def repointed(relations: DataFrame, mapping: DataFrame) -> DataFrame:
    """Relations (id, subject, predicate, object, confidence) between canonical entities, one for each triple: that of the highest
    confidence, then the smallest id, with n, how many fell together. What ``mapping`` (id, canonical) doesn't name stays;
    a relation of what has become one thing to itself stays too."""
    out = relations
    for end in ("subject", "object"):
        ids = mapping.where("id <> canonical").select(F.col("id").alias(end), "canonical")
        out = out.join(ids, end, "left").withColumn(end, F.coalesce("canonical", end)).drop("canonical")
    best = F.min_by(F.struct("id", "confidence"), F.struct(-F.coalesce("confidence", F.lit(float("-inf"))), F.col("id")))
    return out.groupBy("subject", "predicate", "object").agg(best.alias("best"), F.count("*").alias("n")).select("subject", "predicate", "object", "best.confidence", "best.id", "n")
