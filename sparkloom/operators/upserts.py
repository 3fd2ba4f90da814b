"""Keyed writes as DataFrames: the state after a batch of writes, with conflicts, supersession and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import latest, ranked


def upserted(index: DataFrame, batch: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The index with the rows of the batch in the place of its own; of several rows of a key the first by ``order``. Rows that
    the batch doesn't name are not rewritten by value, only passed by the anti join."""
    last = latest(batch, [key], order)
    return index.join(last.select(key), key, "left_anti").unionByName(last.select(*index.columns))


def facts_set(writes: DataFrame, at: list[str], cap: int) -> DataFrame:
    """State of each (owner, key) after ``writes`` (owner, key, value, importance, scope, supersedes and the columns ``at``,
    unique within an owner): the last value, the union of scopes, and whether the key is active, superseded by a later write
    of its owner that names it, or evicted, as it lies past the ``cap`` most important active keys of its owner."""
    when = F.struct(*at)
    state = writes.groupBy("owner", "key").agg(
        F.max(when).alias("last"),
        F.max_by("value", when).alias("value"),
        F.max_by("importance", when).alias("importance"),
        F.array_sort(F.collect_set("scope")).alias("scopes"),  # a key's scopes are few: meetings or files it was said in
    )
    named = writes.where("supersedes IS NOT NULL").groupBy("owner", F.col("supersedes").alias("key")).agg(F.max(when).alias("named"))
    state = state.join(named, ["owner", "key"], "left").withColumn("superseded", F.coalesce(F.col("named") > F.col("last"), F.lit(False)))
    placed = ranked(state, [F.desc("importance"), F.asc("key")], ["owner", "superseded"], "place")
    kind = F.when(F.col("superseded"), "superseded").when(F.col("place") > cap, "evicted").otherwise("active")
    return placed.select("owner", "key", "value", "scopes", kind.alias("state"))


def resolved(facts: DataFrame, requests: DataFrame, declared: DataFrame, requested: DataFrame) -> DataFrame:
    """Facts (key, project, revision, status, valid_to) after conflicts were resolved.

    A request (winner, expected_revision, at) counts if the winner still has that revision, the losers in ``requested``
    (winner, loser) are exactly those it has ``declared``, at least one, and each of them is active and of no other project.
    Then the winner is confirmed and each loser superseded by it, its validity closed if open; both get a new revision. Of
    several winners of one loser the smallest key is named. Requests that don't count change nothing.
    """
    own = facts.select(F.col("key").alias("winner"), F.col("project").alias("p"), F.col("revision").alias("r"))
    fresh = requests.join(own, "winner").where("r = expected_revision").select("winner", "p", "at")
    lost = facts.select(F.col("key").alias("loser"), F.col("project").alias("q"), "status")
    both = declared.distinct().withColumn("d", F.lit(True)).join(requested.distinct().withColumn("n", F.lit(True)), ["winner", "loser"], "full_outer")
    pairs = fresh.join(both, "winner").join(lost, "loser", "left")
    sound = F.col("d") & F.col("n") & ~F.col("status").isin("retracted", "superseded") & (F.col("p").isNull() | F.col("q").isNull() | (F.col("p") == F.col("q")))
    pairs = pairs.select("winner", "loser", "at", F.coalesce(sound, F.lit(False)).alias("sound"))
    good = pairs.groupBy("winner").agg(F.bool_and("sound").alias("ok")).where("ok").select("winner")
    won = good.select(F.col("winner").alias("key"), F.lit(True).alias("won"))
    over = pairs.join(good, "winner", "left_semi").groupBy(F.col("loser").alias("key")).agg(F.min(F.struct("winner", "at")).alias("by"))
    after = facts.join(won, "key", "left").join(over, "key", "left")
    status = F.when(F.col("by").isNotNull(), "superseded").when(F.col("won"), "confirmed").otherwise(F.col("status"))
    touched = (F.col("by").isNotNull() | F.coalesce("won", F.lit(False))).cast("int")
    ends = F.when(F.col("by").isNotNull(), F.coalesce("valid_to", "by.at")).otherwise(F.col("valid_to"))
    return after.select("key", "project", (F.col("revision") + touched).alias("revision"), status.alias("status"), ends.alias("valid_to"), F.col("by.winner").alias("superseded_by"))
