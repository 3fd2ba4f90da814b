"""Chains of a key and its successor, for all keys at once, by doubling.

After round r each key knows where 2**r steps lead, so the rounds are the logarithm of the depth, each a join or two of tables
with one row a key. A key has at most one successor (a fact supersedes one fact, a session has one parent); going the
other way, a key's followers are those whose chain passes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import persisted


def reaches(links: DataFrame, depth: int) -> DataFrame:
    """start, node and step of every node within ``depth`` steps of every start, the start itself as step 0.

    ``links`` has source and target; of several targets of a source the smallest counts, null sources and targets don't. A chain
    ends where it would meet a node again, so a cycle is gone through once; a key that links to itself is alone. The rows
    are as many as the chains are long, which is what a timeline of every key is; they are made at the end, without an exchange:
    rounds move one row a key, with its way so far as an array of ``depth`` + 1 nodes at most.
    """
    next_ = persisted(links.where("source IS NOT NULL AND target IS NOT NULL AND source <> target").groupBy("source").agg(F.min("target").alias("target")))
    ends = next_.select(F.col("target").alias("node")).distinct().join(next_.select(F.col("source").alias("node")), "node", "left_anti")
    linked = next_.select(F.col("source").alias("start"), F.slice(F.array("source", "target"), 1, depth + 1).alias("way"))
    ways = linked.unionByName(ends.select(F.col("node").alias("start"), F.array("node").alias("way")))
    reach = 1
    while reach < depth:
        # A way of ``reach`` steps goes on with the way of its last node; a shorter one has ended. What repeats only does so from where a cycle closes.
        ways = persisted(ways)
        going = ways.where(F.size("way") > reach)
        if going.isEmpty():
            break
        more = ways.select(F.col("start").alias("last"), F.slice("way", 2, min(reach, depth - reach)).alias("more"))
        longer = going.withColumn("last", F.element_at("way", -1)).join(more, "last").select("start", F.array_distinct(F.concat("way", "more")).alias("way"))
        ways = longer.unionByName(ways.where(F.size("way") <= reach))
        reach *= 2
    return ways.select("start", F.posexplode("way").alias("step", "node")).select("start", "node", "step")


def timelines(links: DataFrame, depth: int) -> DataFrame:
    """start, node and step of everything before and after every key: positive along the links, negative against them. On a
    cycle a node is both, and the nearer way counts, forward if they are equal."""
    forward = reaches(links, depth)
    back = forward.where("step > 0").select(F.col("node").alias("start"), F.col("start").alias("node"), (-F.col("step")).alias("step"))
    both = forward.unionByName(back)
    return both.groupBy("start", "node").agg(F.min_by("step", F.struct(F.abs("step"), -F.col("step"))).alias("step"))


def heads(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, head and steps: the end of each node's chain, without the steps between. On a cycle, which has no end, the head is
    its smallest node and steps is null, as it is for what leads into a cycle.

    Before round k every node less than 2**k steps from its end is settled, and only the others go on, so rounds are the
    logarithm of the longest chain. A round that settles none leaves only what leads into cycles: on a longer chain some node would
    have been that far from its end.
    """
    next_ = persisted(links.where("source IS NOT NULL AND target IS NOT NULL AND source <> target").groupBy("source").agg(F.min("target").alias("target")))
    ends = next_.select(F.col("target").alias("node")).distinct().join(next_.select(F.col("source").alias("node")), "node", "left_anti")
    settled = persisted(ends.select("node", F.col("node").alias("head"), F.lit(0).cast("long").alias("steps")))
    state = next_.select(F.col("source").alias("node"), F.col("target").alias("head"), F.col("target").alias("least"))
    left, cyclic = state.count(), False
    for k in range(rounds):
        if not left or (cyclic and 1 << k >= left):
            break
        way = state
        if not cyclic:
            there = settled.select(F.col("node").alias("head"), F.col("head").alias("end"), "steps")
            way = met = persisted(state.join(there, "head", "left"))
            settled = settled.unionByName(met.where("end IS NOT NULL").select("node", F.col("end").alias("head"), (F.col("steps") + (1 << k)).alias("steps")))
            state = met.where("end IS NULL").select("node", "head", "least")
            before, left = left, state.count()
            cyclic = left == before
        other = way.select(F.col("node").alias("head"), F.col("head").alias("next"), F.col("least").alias("low"))
        state = persisted(state.join(other, "head").select("node", F.col("next").alias("head"), F.least("least", "low").alias("least")))
    least = state.select(F.col("head").alias("node")).distinct().join(state.select("node", "least"), "node").select(F.col("node").alias("head"), F.col("least").alias("cycle"))
    return settled.unionByName(state.join(least, "head").select("node", F.col("cycle").alias("head"), F.lit(None).cast("long").alias("steps")))
