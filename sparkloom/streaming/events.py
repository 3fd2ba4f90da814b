"""Event-time operators: the batch forms of sliding rates and per-key state machines, and their streaming forms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trailing_error_rate(events: DataFrame, key: str, seconds: int = 60) -> DataFrame:
    """Share of errors in the last ``seconds`` up to each event; one that is just so old is out."""
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    w = Window.partitionBy(key).orderBy(at).rangeBetween(1 - seconds, 0)
    return events.withColumn("rate", F.avg((F.col("event_type") == "error").cast("int")).over(w))


def windowed_error_rate(events: DataFrame, window: str = "60 seconds", slide: str = "10 seconds", late: str = "5 minutes") -> DataFrame:
    """The same of a stream: sliding windows, final once the watermark passes them."""
    flag = (F.col("event_type") == "error").cast("int")
    return events.withWatermark("ts", late).groupBy(F.window("ts", window, slide).alias("w")).agg(F.avg(flag).alias("rate"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "rate", "n")


def session_counts(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def once(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first of equal keys, whose state the watermark ends."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


class Breaker:
    """closed -> open after so many failures in a row -> half-open after a pause -> closed after so many successes."""

    def __init__(self, failures: int = 3, pause: float = 3600.0, successes: int = 2):
        self.limit, self.pause, self.needed = failures, pause, successes
        self.state, self.failed, self.passed, self.opened = "closed", 0, 0, 0.0

    def step(self, at: float, ok: bool) -> str:
        if self.state == "open" and at - self.opened >= self.pause:
            self.state, self.passed = "half-open", 0
        if self.state == "open":
            return "rejected"
        if ok:
            self.failed, self.passed = 0, self.passed + 1
            if self.state == "half-open" and self.passed >= self.needed:
                self.state = "closed"
        else:
            self.failed += 1
            if self.state == "half-open" or self.failed >= self.limit:
                self.state, self.opened = "open", at
        return self.state


def _replayed(events: DataFrame, key: str, make, step, schema: str) -> DataFrame:
    """Run a state machine over each key's events in order. Rows come in batches; only the state is kept between them."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    ordered = events.select(key, "event_id", at.alias("at"), (F.col("event_type") != "error").alias("ok")).repartition(key).sortWithinPartitions(key, "at", "event_id")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, owner, first = None, None, True
        for rows in batches:
            out = []
            for k, when, ok in zip(rows[key], rows["at"], rows["ok"]):
                if first or k != owner:
                    machine, owner, first = make(), k, False
                out.append(step(machine, when, ok))
            yield rows[[key, "event_id"]].assign(outcome=out)

    return ordered.mapInPandas(work, schema)


def breaker(events: DataFrame, key: str) -> DataFrame:
    kind = events.schema[key].dataType.simpleString()
    return _replayed(events, key, Breaker, lambda m, at, ok: m.step(at, ok), f"{key} {kind}, event_id long, outcome string")


class Bucket:
    def __init__(self, rate: float, burst: float):
        self.rate, self.burst, self.tokens, self.last = rate, burst, burst, None

    def step(self, at: float) -> str:
        self.tokens = min(self.burst, self.tokens + (0 if self.last is None else (at - self.last) * self.rate))
        self.last = at
        if self.tokens < 1:
            return "limited"
        self.tokens -= 1
        return "passed"


def token_bucket(events: DataFrame, key: str, rate: float, burst: float) -> DataFrame:
    kind = events.schema[key].dataType.simpleString()
    return _replayed(events, key, lambda: Bucket(rate, burst), lambda m, at, ok: m.step(at), f"{key} {kind}, event_id long, outcome string")
