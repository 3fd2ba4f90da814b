"""Recall of facts for a question: nearest vectors whose facts still stand, a second hop, the important ones, and a scope's policy.

What a vector finds is held against its fact before the nearest are cut, so the cut is always full of facts that stand, however
many vectors are stale, and nothing has to be fetched again. All later steps work on bounded pools.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from . import ranking

#: Weights of nearness, freshness, importance, confidence and usefulness.
WEIGHTS = (0.35, 0.15, 0.25, 0.15, 0.10)


@dataclass(frozen=True)
class Policy:
    """limit of results, pool of candidates, seeds of the second hop and places reserved for what it bridges, facts of no scope at
    most (profiles apart), whether those are let in at all, and the least importance."""

    limit: int = 8
    pool: int = 40
    hop: int = 16
    seeds: int = 2
    unscoped: int = 3
    strict: bool = False
    least: float = 1.0


def standing(facts: DataFrame, vectors: DataFrame, scopes: Sequence[str], policy: Policy) -> tuple[DataFrame, DataFrame]:
    """Facts that may be recalled, and those of them whose vector was made from their present revision, with it.

    ``facts``: id, revision, active, scope (null: none), category, legacy, importance, freshness, confidence, usefulness, text.
    ``vectors``: id, revision (null: of before revisions were kept, so only of a first one), embedding. Without ``scopes`` every
    scope is asked for.
    """
    profile = F.lower(F.coalesce("category", F.lit(""))).isin("profile", "user_profile")
    allowed = facts.where(F.col("active") & (F.col("importance") >= policy.least))
    if scopes:
        free = F.col("scope").isNull() & (profile | (~F.coalesce("legacy", F.lit(False)) & F.lit(not policy.strict)))
        allowed = allowed.where(F.coalesce(F.col("scope").isin(*scopes), F.lit(False)) | free)
    allowed = allowed.withColumn("profile", profile)
    made = vectors.select("id", F.col("revision").alias("made_from"), "embedding")
    fenced = allowed.join(made, "id").where(F.coalesce(F.col("made_from") == F.col("revision"), F.col("revision") <= 1))
    return allowed, fenced.drop("made_from")


def nearest(fenced: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """id, similarity, embedding and text of the k nearest to the one vector ``q`` in ``query``, or none without one."""
    near = fenced.crossJoin(F.broadcast(query.limit(1))).withColumn("d", N.l2(F.col("embedding"), F.col("q")))
    return near.orderBy("d", "id").limit(k).select("id", N.relevance(F.col("d"), True).alias("similarity"), "embedding", "text")


def recall(facts: DataFrame, vectors: DataFrame, query: DataFrame, question: Sequence[str], scopes: Sequence[str] = (), policy: Policy | None = None) -> DataFrame:
    """id, score, similarity, bridge (null where the place isn't a reserved one) and rank of what is recalled.

    The first hop's facts that share most words with the question are seeds; the second hop looks near the first seed. What
    shares words with the question and all seeds bridges, and the best of that is placed first. The important facts come in
    beside the near ones, with a similarity of 0. Ties go to the smaller id.
    """
    policy = policy or Policy()
    allowed, fenced = standing(facts, vectors, scopes, policy)
    words = F.array(*map(F.lit, question)).cast("array<string>")
    tokens = F.array_distinct(T.tokens(F.col("text")))
    first = nearest(fenced, query, policy.pool).withColumn("w", tokens)
    shared = first.withColumn("shared", F.size(F.array_intersect("w", words))).where("shared > 0")
    seeds = ranking.top(shared, [F.desc("shared"), F.desc("similarity"), F.asc("id")], policy.seeds)
    expanded = seeds.agg(F.flatten(F.collect_list("w")).alias("s")).where(F.size("s") > 0).select(F.array_union(words, F.col("s")).alias("e"))
    second = nearest(fenced, seeds.where("rank = 1").select(F.col("embedding").alias("q")), policy.hop).withColumn("w", tokens)
    found = first.unionByName(second).groupBy("id").agg(F.max("similarity").alias("similarity"), F.first("w").alias("w"))
    bridged = found.join(F.broadcast(expanded), how="left").withColumn("bridge", F.when(F.size("e") > 0, T.overlap_coefficient(F.col("w"), F.col("e"))))
    near = bridged.select("id", "similarity", F.when(F.col("bridge") > 0, F.col("bridge")).alias("bridge"))
    important = allowed.orderBy(F.desc("importance"), "id").limit(policy.pool).select("id", F.lit(0.0).alias("similarity"), F.lit(None).cast("double").alias("bridge"))
    pool = near.unionByName(important).groupBy("id").agg(F.max("similarity").alias("similarity"), F.max("bridge").alias("bridge"))
    parts: list[tuple[float, Column]] = list(zip(WEIGHTS, (F.col("similarity"), F.col("freshness"), (F.col("importance") - 1) / 4.0, F.col("confidence"), F.col("usefulness"))))
    scored = allowed.drop("text").join(F.broadcast(pool), "id").withColumn("score", F.round(N.weighted_average(parts), 9))
    if scopes:
        counted = F.col("scope").isNull() & ~F.col("profile")
        free = ranking.top(scored.where(counted), [F.desc("score"), F.asc("id")], policy.unscoped).drop("rank")
        kept = scored.where(~counted).unionByName(free)
    else:
        kept = scored
    order = [F.desc_nulls_last("bridge"), F.desc("score"), F.asc("id")]
    reserved = ranking.ranked(kept, order, name="n").withColumn("bridge", F.when(F.col("n") <= min(policy.seeds, policy.limit), F.col("bridge")))
    return ranking.top(reserved, [F.col("bridge").isNull().asc(), *order], policy.limit).select("id", "score", "similarity", "bridge", "rank")
