"""Versioned facts: bitemporal snapshots, differences, chains and lifecycle. The instant is always an argument."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import latest


def as_of(versions: DataFrame, key: list[str], valid: Column, known: Column, order: list[Column]) -> DataFrame:
    """Latest revision of each key among versions valid at ``valid`` and recorded by ``known``.

    Validity is half-open. A later retraction hides an older version, so filters on the content come after this.
    """
    open_ = (F.col("valid_from") <= valid) & (F.col("valid_to").isNull() | (F.col("valid_to") > valid))
    return latest(versions.where(open_ & (F.col("recorded_at") <= known)), key, order)


def joined_null_safe(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Joined by columns of which nulls are equal; the columns of the left side stay."""
    other = right.select(*(F.col(c).alias(f"_{c}" if c in by else c) for c in right.columns))
    condition = F.lit(True)
    for c in by:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return left.join(other, condition, how).drop(*(f"_{c}" for c in by))


def closed(versions: DataFrame, key: list[str], order: list[Column], at: str = "recorded_at") -> DataFrame:
    """revision and recorded_to of append-only versions: each ends when the next is recorded."""
    w = Window.partitionBy(*key).orderBy(*order)
    return versions.withColumn("revision", F.row_number().over(w)).withColumn("recorded_to", F.lead(at).over(w))


def differences(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, change (added, removed, changed) and the names of changed fields of two snapshots."""
    a, b = old.select(key, *(F.col(f).alias(f"old_{f}") for f in fields), F.lit(True).alias("in_old")), new.select(key, *(F.col(f).alias(f"new_{f}") for f in fields), F.lit(True).alias("in_new"))
    both = a.join(b, key, "full_outer")
    names = F.array_compact(F.array(*(F.when(~F.col(f"old_{f}").eqNullSafe(F.col(f"new_{f}")), F.lit(f)) for f in fields)))
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.size(names) > 0, "changed")
    return both.select(key, change.alias("change"), F.array_join(F.when(change == "changed", names), ",").alias("fields")).where("change IS NOT NULL")


def capped(facts: DataFrame, owner: str, order: list[Column], cap: int) -> DataFrame:
    """What lies past the cap of each owner."""
    return facts.withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy(*order))).where(F.col("place") > cap)


def chain(edges: DataFrame, start: list, depth: int = 100) -> DataFrame:
    """Keys reached from ``start`` along (source, target), with the fewest steps. Cycles end, as do chains at ``depth``. For the
    chains of all keys see ``chains``."""
    spark = edges.sparkSession
    names = [f"chain_{uuid.uuid4().hex}" for _ in range(2)]
    kind = edges.schema["source"].dataType.simpleString()
    edges.createOrReplaceTempView(names[0])
    spark.createDataFrame([(x,) for x in start], f"node {kind}").createOrReplaceTempView(names[1])
    found = spark.sql(
        f"WITH RECURSIVE r(node, step) AS (SELECT node, 0 FROM {names[1]} UNION ALL SELECT e.target, r.step + 1 FROM r JOIN {names[0]} e ON e.source = r.node WHERE r.step < {int(depth)}) SELECT node, min(step) AS step FROM r GROUP BY node"
    )
    for name in names:
        spark.catalog.dropTempView(name)
    return found


def islands(events: DataFrame, key: str, time: str, tie: str, gap_seconds: int) -> DataFrame:
    """A session number for each event: a new one after more than ``gap_seconds`` of silence."""
    w = Window.partitionBy(key).orderBy(time, tie)
    quiet = F.unix_timestamp(F.col(time).cast("timestamp")) - F.unix_timestamp(F.lag(time).over(w).cast("timestamp")) > gap_seconds
    return events.withColumn("session", F.sum(F.coalesce(quiet, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def runs(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """A run number for each row: a new one where ``value`` changes."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)
    return events.withColumn("run", F.sum(changed.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def within(df: DataFrame, by: list[str], at: str, reach: int, name: str) -> DataFrame:
    """How many rows of a group, the row itself too, lie less than ``reach`` microseconds from each row. Rows meet in spans as
    long as the reach, each also in the spans before and after its own, and are counted by a sliding frame: no pairs are made, and
    a busy group is dealt out by time. A null time has no row."""
    at_us = F.unix_micros(F.col(at).cast("timestamp"))
    span = F.floor(F.col("_us") / reach)
    spread = df.where(F.col(at).isNotNull()).withColumn("_us", at_us).withColumn("_off", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("_span", span + F.col("_off"))
    near = Window.partitionBy(*by, "_span").orderBy("_us").rangeBetween(-(reach - 1), reach - 1)
    return spread.withColumn(name, F.count("*").over(near)).where("_off = 0").drop("_us", "_off", "_span")
