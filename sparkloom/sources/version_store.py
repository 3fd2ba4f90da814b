"""Versions of facts laid out by the time in which they are valid, so that a question about an instant reads only those near it.

A closed version lies in a cell of a dyadic grid: its level is the smallest power of two of days that its time fits into, its
slot where that time begins, so at an instant just two slots of each level can matter. An open version lies in a cell of the
day on which it begins. Files are sorted and range-partitioned by cell: the filter on cells, times of validity and times of
recording reaches the scan, and Parquet's statistics skip the rest of history.

A state of the store is one small file that names its folders, put in place by one writer only. An append closes what it
supersedes, writes the versions that are closed now beside those of before, and the open ones anew.

Times are without zone. ``valid_to`` and ``recorded_to`` are when a version ends and when that was recorded; null is open.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Files, shared_folder

EPOCH = date(1970, 1, 1)
#: Cells of one level, whose slots lie around its middle; the level of open versions.
SPAN, OPEN = 1 << 24, 31
TIMES = ("valid_from", "valid_to", "recorded_at", "recorded_to")


def day(c: Column) -> Column:
    return F.datediff(c.cast("date"), F.lit(EPOCH))


def level_of(begin: Column, end: Column) -> Column:
    return F.ceil(F.log2(F.greatest(day(end) - day(begin), F.lit(0)) + 1)).cast("int")


def with_cell(versions: DataFrame) -> DataFrame:
    begin, level = day(F.col("valid_from")), level_of(F.col("valid_from"), F.col("valid_to"))
    slot = F.floor(begin / F.pow(F.lit(2.0), level)).cast("long")
    place = F.when(F.col("valid_to").isNull(), F.lit(OPEN * SPAN) + begin).otherwise(level.cast("long") * SPAN + slot) + SPAN // 2
    return versions.withColumn("cell", place.cast("long"))


def cells_at(levels: Sequence[int], instant: datetime) -> Column:
    """The cells that can hold a version valid at ``instant``."""
    d = (instant.date() - EPOCH).days
    ranges = [(level * SPAN + SPAN // 2 + (d >> level) - 1, level * SPAN + SPAN // 2 + (d >> level)) for level in levels if level < OPEN]
    ranges += [(OPEN * SPAN, OPEN * SPAN + SPAN // 2 + d)] * (OPEN in levels)
    return reduce(Column.__or__, (F.col("cell").between(*r) for r in ranges), F.lit(False))


def literal(instant: datetime) -> Column:
    return F.lit(instant.isoformat(sep=" ")).cast("timestamp_ntz")


class VersionStore:
    """State ``number`` of a store."""

    def __init__(self, spark: SparkSession, root: str, number: int):
        self.spark, self.root, self.number = spark, root, number
        entry = json.loads(Files(spark, root).text(state_name(root, number)))
        self.key, self.closed, self.open, self.levels = entry["key"], entry["closed"], entry["open"], entry["levels"]

    def versions(self) -> DataFrame:
        """All versions, with revision, times and cell."""
        return self.spark.read.parquet(*self.closed, self.open)

    def near(self, valid: datetime, known: datetime | None = None) -> DataFrame:
        """Versions valid at ``valid`` as far as was known at ``known`` (null: now), by filters that reach the scan.

        A version that ended only by what was recorded after ``known`` had not ended then.
        """
        at = literal(valid)
        open_ = F.col("valid_to").isNull() | (F.col("valid_to") > at)
        ok = cells_at(self.levels, valid) & (F.col("valid_from") <= at) & open_
        if known is not None:
            then = literal(known)
            still = (F.col("recorded_to") > then) & (F.col("valid_from") <= at)
            ok = (ok | still) & (F.col("recorded_at") <= then)
        return self.versions().where(ok)

    def as_of(self, valid: datetime, known: datetime | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        """The key, the columns asked for (all if None) and the revision of each key's latest such version. Filters on content come after."""
        found = self.near(valid, known)
        wanted = [c for c in (columns or found.columns) if c not in (self.key, "cell", "revision")]
        last = F.max_by(F.struct("revision", *wanted), F.struct("revision", "recorded_at"))
        return found.groupBy(self.key).agg(last.alias("v")).select(self.key, "v.*")


def state_name(root: str, number: int) -> str:
    return f"{root}/states/{number:012d}.json"


def last(spark: SparkSession, root: str) -> int:
    return max((int(x[:-5]) for x in Files(spark, root).names(f"{root}/states") if x[:-5].isdigit()), default=0)


def opened(spark: SparkSession, root: str, number: int | None = None) -> VersionStore | None:
    number = last(spark, root) if number is None else number
    return VersionStore(spark, root, number) if number else None


def closed_by_next(versions: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """revision, valid_to and recorded_to of versions with valid_from, recorded_at and ``base``, the revision before their key's
    first: each ends when the key's next begins, if it has no end already."""
    w = Window.partitionBy(key).orderBy("recorded_at", *order)
    ends = {c: F.coalesce(F.col(c), F.lead(of).over(w)) for c, of in (("valid_to", "valid_from"), ("recorded_to", "recorded_at"))}
    return versions.withColumns({**ends, "revision": F.col("base") + F.row_number().over(w)}).drop("base")


def written(versions: DataFrame, folder: str) -> DataFrame:
    with_cell(versions).repartitionByRange("cell").sortWithinPartitions("cell").write.parquet(folder)
    return versions.sparkSession.read.parquet(folder)


def append(versions: DataFrame, root: str, key: str, order: Sequence[str] = (), expected: int | None = None) -> VersionStore:
    """Add versions (key, valid_from, recorded_at, more columns; valid_to if some have an end of their own) and return the new state.

    Versions of a key follow one another by recorded_at, then ``order``; those appended come after those that are there. Only
    open versions of the keys at hand are read again. Null keys and times of recording are refused. Fails, and leaves the
    store as it was, if another state was put in place since ``expected``.
    """
    spark = versions.sparkSession
    files = Files(spark, root)
    start = last(spark, root) if expected is None else expected
    before = opened(spark, root, start) if start else None
    folder = f"{root}/{uuid.uuid4().hex}"
    try:
        new = versions.withColumn("base", F.lit(0).cast("long")).withColumn("recorded_to", F.lit(None).cast("timestamp_ntz"))
        new = new if "valid_to" in new.columns else new.withColumn("valid_to", F.lit(None).cast("timestamp_ntz"))
        new.write.parquet(f"{folder}/new")
        new = spark.read.parquet(f"{folder}/new")
        if not new.where(f"`{key}` IS NULL OR valid_from IS NULL OR recorded_at IS NULL").isEmpty():
            raise ValueError("a version needs a key and times")
        if before is not None:
            there = spark.read.parquet(before.open).drop("cell")
            mine = there.join(new.select(key).distinct(), key, "left_semi")
            again = mine.withColumn("base", F.col("revision") - 1).drop("revision").unionByName(new)
            again = again.withColumn("base", F.max("base").over(Window.partitionBy(key)))
            other = there.join(new.select(key).distinct(), key, "left_anti")
        else:
            again, other = new, None
        made = closed_by_next(again, key, order).withColumn("revision", F.col("revision").cast("long"))
        made.write.parquet(f"{folder}/made")
        made = spark.read.parquet(f"{folder}/made")
        ended = F.col("recorded_to").isNotNull()
        closed = written(made.where(ended), f"{folder}/closed")
        still = made.where(~ended)
        open_ = written(still if other is None else still.unionByName(other), f"{folder}/open")
        levels = closed.unionByName(open_).select((F.col("cell") / SPAN).cast("int").alias("l")).distinct()
        seen = {r.l for r in levels.collect()} | set(before.levels if before else [])
        for part in ("new", "made"):
            files.delete(f"{folder}/{part}")
        entry = {"key": key, "closed": [*(before.closed if before else []), f"{folder}/closed"], "open": f"{folder}/open", "levels": sorted(seen)}
        if not files.put_new(state_name(root, start + 1), json.dumps(entry)):
            raise RuntimeError(f"state {start + 1} was put in place by another")
    except BaseException:
        files.delete(folder)
        raise
    return VersionStore(spark, root, start + 1)


def compact(spark: SparkSession, root: str) -> VersionStore:
    """The closed versions of all appends in one folder again; older states stay readable."""
    now = opened(spark, root)
    folder = f"{root}/{uuid.uuid4().hex}"
    written(spark.read.parquet(*now.closed).drop("cell"), f"{folder}/closed")
    entry = {"key": now.key, "closed": [f"{folder}/closed"], "open": now.open, "levels": now.levels}
    if not Files(spark, root).put_new(state_name(root, now.number + 1), json.dumps(entry)):
        Files(spark, root).delete(folder)
        raise RuntimeError(f"state {now.number + 1} was put in place by another")
    return VersionStore(spark, root, now.number + 1)


def of_table(versions: DataFrame, path: str, name: str, key: str, order: Sequence[str] = ()) -> VersionStore:
    """The store of a stored table's versions in the shared folder, made by the first that asks and again once the table has changed."""
    spark = versions.sparkSession
    state = json.dumps([Files(spark, path).states(path), name, key, versions.columns])
    root = f"{shared_folder(spark)}/versions-{name}-{uuid.uuid5(uuid.NAMESPACE_URL, state).hex}"
    store = opened(spark, root)
    if store is None:
        return append(versions, root, key, order, expected=0)
    files = Files(spark, root)
    if all(files.exists(f"{folder}/_SUCCESS") for folder in (*store.closed, store.open)):
        return store
    files.delete(root)  # a cleared folder: what is left of it is of no use
    return append(versions, root, key, order, expected=0)
