"""State by key with event-time timers: events are taken in order of their time, however they arrive.

An event waits in its key's state until the watermark has passed it; then nothing older can come any more, as Spark drops what
does. A timer wakes the key, which takes all that waited in order of time and id, once each, and steps its machine; the
machine says when it wants to be woken without an event, as when a lease runs out. So the rows that come out are those of
the sorted table, whatever the batches, up to the last watermark.

State lives in RocksDB and the checkpoint; a stream that is started again goes on where it was.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..sources.store import Files

# Machines travel to the workers as they are, so these need not find this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Machine:
    """What a key does: ``state`` is a tuple of its own, None before the first event; times are microseconds."""

    columns: str
    state: str

    def step(self, state: tuple | None, at: int, event_id: int, kind: str) -> tuple[tuple | None, list[tuple]]:
        """The state after an event, and rows to give out."""
        raise NotImplementedError

    def wake(self, state: tuple | None) -> int | None:
        """When to be woken if no event comes."""
        return None

    def woken(self, state: tuple) -> tuple[tuple | None, list[tuple]]:
        """The state after that time has passed, and rows to give out."""
        return state, []


class Journal(Machine):
    """Numbers a run's events from 1."""

    columns, state = "event_id long, seq long", "n long"

    def step(self, state, at, event_id, kind):
        n = state[0] + 1 if state else 1
        return (n,), [(event_id, n)]


class Leases(Machine):
    """A job is leased by any event but one of ``done``, which completes it; a lease that is not renewed for ``seconds`` runs out and the
    job is queued again, or a dead letter at the ``most``-th time since it was last completed, from where it begins anew."""

    columns, state = "expired timestamp, state string, attempts int", "until long, attempts int"

    def __init__(self, seconds: int, most: int = 3, done: str = "purchase"):
        self.reach, self.most, self.done = seconds * 1_000_000, most, done

    def step(self, state, at, event_id, kind):
        if kind == self.done:
            return (None, 0), []
        return (at + self.reach, state[1] if state else 0), []

    def wake(self, state):
        return state[0] if state else None

    def woken(self, state):
        attempts = state[1] + 1
        dead = attempts >= self.most
        row = (pd.Timestamp(state[0], unit="us"), "dead_letter" if dead else "queued", attempts)
        return (None, 0 if dead else attempts), [row]


class Anchors(Machine):
    """An anchor lives for ``seconds`` after it was last touched, in whole seconds; then its number, touches and first time come out."""

    columns, state = "session long, n long, first long", "until long, n long, first long, session long"

    def __init__(self, seconds: int):
        self.seconds = seconds

    def step(self, state, at, event_id, kind):
        until = (at // 1_000_000 + self.seconds + 1) * 1_000_000 - 1  # the last microsecond that touches it
        if state and state[0] is not None:
            return (until, state[1] + 1, state[2], state[3]), []
        return (until, 1, at // 1_000_000, (state[3] if state else 0) + 1), []

    def wake(self, state):
        return state[0] if state else None

    def woken(self, state):
        return (None, 0, 0, state[3]), [(state[3], state[1], state[2])]


class InOrder(StatefulProcessor):
    """Runs a machine for each key."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.names = ["_key", *(x.split()[0] for x in machine.columns.split(", "))]

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events string")  # of a batch each, as every row of a state costs a call's time
        self.own = handle.getValueState("own", self.machine.state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(at), int(i), kind) for part in rows for at, i, kind in zip(part["at"], part["event_id"], part["kind"])]
        if new:
            self.waiting.appendValue((json.dumps(new),))
            self.handle.registerTimer(milliseconds(min(new)[0]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted({tuple(e) for part in self.waiting.get() for e in json.loads(part[0])})
        state, out = self.own.get(), []

        def until(time: int, strict: bool) -> None:
            nonlocal state
            wake = self.machine.wake(state)
            while wake is not None and (wake < time if strict else wake <= time):
                state, rows = self.machine.woken(state)
                out.extend(rows)
                wake = self.machine.wake(state)

        for at, event_id, kind in events:
            if at > passed:
                break
            until(at, True)
            state, rows = self.machine.step(state, at, event_id, kind)
            out.extend(rows)
        until(passed, False)
        rest = [e for e in events if e[0] > passed]
        if len(rest) < len(events):
            self.waiting.put([(json.dumps(rest),)]) if rest else self.waiting.clear()
        if state is not None:
            self.own.update(state)
        next_ = [x for x in (self.machine.wake(state), rest[0][0] if rest else None) if x is not None]
        if next_:
            self.handle.registerTimer(milliseconds(min(next_)))
        if out:
            yield pd.DataFrame([(key[0], *row) for row in out], columns=self.names)

    def close(self) -> None:
        pass


def milliseconds(at: int) -> int:
    """The first whole millisecond at which ``at`` has passed."""
    return -(-at // 1000)


def in_order(events: DataFrame, key: str, machine: Machine, late: str = "0 seconds") -> DataFrame:
    """Rows that the machine gives out for each key of a stream of event_id, ts and event_type; null keys are a key.

    Events that come later than ``late`` behind the newest are dropped, repeated ones of one id and time count once.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kind = events.schema[key].dataType
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    named = F.when(F.col(key).isNull(), "null").otherwise(F.concat(F.lit("="), F.col(key).cast("string")))  # a state's key is not null
    rows = rows.select(named.alias("_key"), "ts", F.unix_micros("ts").alias("at"), "event_id", F.col("event_type").alias("kind"))
    out = rows.groupBy("_key").transformWithStateInPandas(InOrder(machine), f"_key string, {machine.columns}", "Append", "EventTime")
    own = F.when(F.col("_key") != "null", F.substring("_key", 2, 1 << 30)).cast(kind)
    return out.select(own.alias(key), *(x.split()[0] for x in machine.columns.split(", ")))


def drained(spark: SparkSession, source: str, folder: str, key: str, machine: Machine) -> DataFrame:
    """A stream over a stored table run to its end, into ``folder``: what comes out up to the time of the last event."""
    stream = spark.readStream.schema(spark.read.parquet(source).schema)
    if Files(spark, source).is_file(source):  # a stream reads folders
        within, _, name = source.rpartition("/")
        rows = stream.option("pathGlobFilter", name).parquet(within)
    else:
        rows = stream.parquet(source)
    out = in_order(rows, key, machine)
    out.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")
