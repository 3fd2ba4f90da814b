"""Mixing sources to target weights by Pfair scheduling.

Weights are exact fractions. Block j of a source with weight w may be placed from slot floor(j / w) on and must be
placed before slot ceil((j + 1) / w); of the blocks that may be placed, the one with the earliest deadline is. No source
is then ever a whole block ahead of or behind its target, after any number of slots. When a source runs out, the others
go on with their weights rescaled, in a new phase: every document is placed.

What is known of the schedule at one slot is a row for each source: how many blocks it has placed. The driver goes
through the slots once, a block of documents at a time, and keeps only these rows at every SEGMENT-th slot; tasks then
replay the segments side by side, and documents find their slot in the table that results.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow

#: Documents of a block, slots that a task replays, and rows of a bucket in which ranks are counted.
BLOCK, SEGMENT, BUCKET = 64, 1 << 16, 2000


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """Integers in exactly the proportion of the weights, of which those that aren't positive are left out."""
    exact = {s: Fraction(w) for s, w in weights.items() if w > 0}
    scale = lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * scale) for s, x in exact.items()}


@dataclass
class State:
    """Where a schedule stands before ``slot``: enough to go on from there."""

    slot: int
    phase: int
    start: int  # first slot of the phase
    first: dict[str, int]  # blocks that each source of the phase had placed before it
    done: dict[str, int]  # and has placed now


def weights_of(left: list[str], weights: dict[str, int]) -> dict[str, int]:
    """Weights of a phase; sources without weight come last, all with equal weight."""
    return {s: weights[s] for s in left if s in weights} or dict.fromkeys(left, 1)


def begun(blocks: dict[str, int], done: dict[str, int], weights: dict[str, int], slot: int, phase: int) -> State | None:
    """The state in which a phase of the sources that have blocks left begins."""
    left = [s for s, n in blocks.items() if done.get(s, 0) < n]
    active = weights_of(left, weights)
    return State(slot, phase, slot, {s: done.get(s, 0) for s in active}, {s: done.get(s, 0) for s in active}) if left else None


def replay(state: State, weights: dict[str, int], ends: dict[str, int], slots: int) -> Iterator[tuple[int, str, int]]:
    """(slot, source, block) of the next ``slots`` slots of the state's phase, or up to the last block of any source.
    ``state`` moves on with them."""
    own = weights_of(list(state.first), weights)
    total = sum(own.values())
    waiting: list[tuple[int, str]] = []  # release, source
    ready: list[tuple[int, str]] = []  # deadline, source
    for s in own:
        heapq.heappush(waiting, ((state.done[s] - state.first[s]) * total // own[s], s))
    for slot in range(state.slot, state.slot + slots):
        while waiting and waiting[0][0] <= slot - state.start:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(state.done[s] - state.first[s] + 1) * total // own[s]), s))
        _, s = heapq.heappop(ready)
        yield slot, s, state.done[s]
        state.done[s] += 1
        state.slot = slot + 1
        if state.done[s] == ends[s]:
            return
        heapq.heappush(waiting, ((state.done[s] - state.first[s]) * total // own[s], s))


def segments(blocks: dict[str, int], weights: dict[str, int], length: int = SEGMENT) -> Iterator[tuple[State, int]]:
    """A copy of the state at the start of each segment, and its slots; a phase begins a segment of its own."""
    done: dict[str, int] = {}
    state = begun(blocks, done, weights, 0, 0)
    while state:
        copy = State(state.slot, state.phase, state.start, state.first, dict(state.done))
        n = sum(1 for _ in replay(state, weights, blocks, length))
        yield copy, n
        if any(state.done[s] == blocks[s] for s in state.done):
            done |= state.done
            state = begun(blocks, done, weights, state.slot, state.phase + 1)


def slots_table(spark, blocks: dict[str, int], weights: dict[str, int], length: int = SEGMENT) -> DataFrame:
    """s, block, slot, phase and phase_weight of every block. The driver sends a row for each segment."""
    rows = ((x.slot, n, x.phase, x.start, list(x.first), list(x.first.values()), list(x.done.values())) for x, n in segments(blocks, weights, length))
    plan = spark.createDataFrame(rows, "slot long, n long, phase int, start long, s array<string>, first array<long>, done array<long>")
    schema = "s string, block long, slot long, phase int, phase_weight double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                state = State(r["slot"], r["phase"], r["start"], dict(zip(r["s"], r["first"])), dict(zip(r["s"], r["done"])))
                own = weights_of(r["s"], weights)
                total = sum(own.values())
                share = {s: float(Fraction(w, total)) for s, w in own.items()}
                found = list(replay(state, weights, blocks, r["n"]))
                columns = ([x[1] for x in found], [x[2] for x in found], [x[0] for x in found], [r["phase"]] * len(found), [share[x[1]] for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.type_for_alias(t)) for c, t in zip(columns, ("string", "int64", "int64", "int32", "float64"))], [x.split()[0] for x in schema.split(", ")])

    return map_arrow(plan.repartition("slot"), work, schema)


def ranked(df: DataFrame, key: str, order: list[str], counts: dict[str, int], bucket: int = BUCKET) -> DataFrame:
    """``rank`` from 0 of each row within its key. Rows of a key are dealt by hash to ranges of about ``bucket`` rows,
    so a key with a third of all rows is ranked in as many tasks as its size asks for."""
    spark = df.sparkSession
    sizes = spark.createDataFrame([(k, -(-n // bucket)) for k, n in counts.items()], "_key string, _buckets long")  # a row for each source
    hashed = df.withColumn("_hash", F.xxhash64(*order)).join(F.broadcast(sizes), F.col(key) == F.col("_key")).drop("_key")
    part = hashed.withColumn("_part", F.floor((F.col("_hash").cast("double") / 2.0**64 + 0.5) * F.col("_buckets")))
    each = part.groupBy(F.col(key).alias("_k"), F.col("_part").alias("_p")).agg(F.count("*").alias("_n"))
    before = each.select("_k", "_p", (F.sum("_n").over(Window.partitionBy("_k").orderBy("_p")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(key, "_part").orderBy("_hash", *order)) - 1
    out = part.withColumn("_own", own).join(before, (F.col(key) == F.col("_k")) & (F.col("_part") == F.col("_p")))
    return out.withColumn("rank", F.col("_before") + F.col("_own")).drop("_hash", "_buckets", "_part", "_own", "_before", "_k", "_p")


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def sizes_of(documents: DataFrame) -> dict[str, int]:
    """Rows of each source: the driver holds a number for each."""
    return {r["s"]: r["count"] for r in documents.groupBy(source_key(F.col("source")).alias("s")).count().collect()}


def mix(documents: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK, segment: int = SEGMENT, columns: list[str] | None = None) -> DataFrame:
    """All rows: ``row``, a struct of their (or these) columns, with slot, place in its block, block, weight, phase and phase_weight
    (the weight among the sources of the phase); read by slot and place.

    Without weights a source's target is the square root of its size. Documents of a source come in an order given
    by a hash of doc_id and text, so repeated rows are just more rows; a null source is a source. Columns of any name
    may come along. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    sizes = sizes_of(documents)
    target = {s: n**0.5 for s, n in sizes.items()} if weights is None else {"-" if s is None else f"={s}": float(w) for s, w in weights.items()}
    exact = whole_weights({s: target.get(s, 0.0) for s in sizes})
    slots = slots_table(spark, {s: -(-n // block) for s, n in sorted(sizes.items())}, exact, segment)
    total = sum(exact.values())
    shares = spark.createDataFrame([(s, float(Fraction(exact.get(s, 0), total)) if total else 0.0) for s in sizes], "s string, weight double")  # a row for each source
    own = documents.select(F.struct(*(F.col(f"`{c}`") for c in columns or documents.columns)).alias("row"), source_key(F.col("source")).alias("_source"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"))
    rows = ranked(own, "_source", ["_id", "_text"], sizes)
    rows = rows.select("row", F.col("_source").alias("s"), F.floor(F.col("rank") / block).cast("long").alias("block"), (F.col("rank") % block).cast("long").alias("place"))
    # A block has ``block`` rows at most, so neither side of this join has a frequent key.
    return rows.join(slots, ["s", "block"]).join(F.broadcast(shares), "s").select("row", "slot", "place", "block", "weight", "phase", "phase_weight")


def schedule(documents: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK, segment: int = SEGMENT) -> DataFrame:
    """doc_id, source, weight, phase, phase_weight, block, slot and place of each document; cases as in ``mix``."""
    return mix(documents, weights, block, segment, ["doc_id", "source"]).select("row.doc_id", "row.source", "weight", "phase", "phase_weight", "block", "slot", "place")


def in_order(documents: DataFrame, weights: dict[str | None, float] | None = None) -> DataFrame:
    """The same rows and columns, dealt to partitions and sorted in the order of the mix; null sources, null texts, equal
    rows, clashing names and empty tables as in ``mix``."""
    mixed = mix(documents, weights)
    return mixed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select("row.*")
