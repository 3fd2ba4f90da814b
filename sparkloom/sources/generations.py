"""A table of files whose rows are replaced together, without a moment in which a file is half there.

A write puts its rows into a folder of its own, a generation, checks them, and becomes visible by one small commit file with
the next number, which only one writer can create. What a commit did is one row for each file (replaced, or removed: a
tombstone). Readers resolve a number: of each file they see the generation of the last commit up to it, so a reader that holds
a number is never disturbed. Rows of replaced generations stay until ``vacuum``.

A journal entry is made before anything is written and deleted after the commit. A write that fails takes back its folder and its
entry; one that was killed is found by ``recover``, which keeps what was committed and takes back what wasn't.

    root/commits/<number>.json            number, generation, base, fingerprint
    root/actions/generation=<g>/*.parquet the files' key columns, removed, rows, digest
    root/data/generation=<g>/*.parquet    rows
    root/journal/<g>.json                 writes under way

Nothing here grows with rows or files on the driver; it reads commit numbers and one commit at a time.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Files

COMMIT = "number long, generation string, base boolean, fingerprint string"


class Conflict(RuntimeError):
    """Somebody else committed first, or what the write rests on has changed."""


def numbers(spark: SparkSession, root: str) -> list[int]:
    return [int(x[:-5]) for x in Files(spark, root).names(f"{root}/commits") if x.endswith(".json") and x[:-5].isdigit()]


def version(spark: SparkSession, root: str) -> int:
    """Number of the last commit, 0 for a store without any."""
    return max(numbers(spark, root), default=0)


def commits(spark: SparkSession, root: str, at: int | None = None) -> DataFrame:
    """Commits that a reader of number ``at`` needs: those since the last one that replaced everything."""
    found = spark.read.schema(COMMIT).json(f"{root}/commits")
    found = found if at is None else found.where(F.col("number") <= at)
    base = found.where("base").agg(F.max("number").alias("first"))
    return found.crossJoin(F.broadcast(base)).where(F.col("number") >= F.coalesce("first", F.lit(0))).drop("first")


def keys_of(actions: DataFrame) -> list[str]:
    return [c for c in actions.columns if c not in ("removed", "rows", "digest", "generation", "number", "fingerprint", "last")]


def resolved(spark: SparkSession, root: str, at: int | None = None) -> DataFrame:
    """All actions since the last base, with the number of their commit and ``last``, that of the file's last action."""
    actions = spark.read.parquet(f"{root}/actions").join(commits(spark, root, at).drop("base"), "generation")
    by = keys_of(actions)
    last = actions.groupBy(*by).agg(F.max("number").alias("last"))
    return joined(actions, last, by, "inner")


def joined(left: DataFrame, right: DataFrame, by: list[str], how: str) -> DataFrame:
    """Joined by key columns of which nulls are equal; a null file is a file."""
    other = right.select(*(F.col(c).alias(f"_{c}" if c in by else c) for c in right.columns))
    return left.join(other, reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by)), how).drop(*(f"_{c}" for c in by))


def live(spark: SparkSession, root: str, at: int | None = None) -> DataFrame:
    """One row for each file that is there: key columns, generation, number, rows, digest, fingerprint."""
    return resolved(spark, root, at).where("number = last AND NOT removed").drop("removed", "last")


def read(spark: SparkSession, root: str, at: int | None = None) -> DataFrame | None:
    """Rows of the files that are there, with their generation; None for a store without commits.

    Rows of superseded generations are taken out by an anti-join with the superseded files, which are few beside the rows
    as long as ``compact`` runs now and then.
    """
    if not version(spark, root):
        return None
    actions = resolved(spark, root, at)
    by = keys_of(actions)
    gone = actions.where("number < last OR removed").select(*by, "generation")
    rows = spark.read.parquet(f"{root}/data").join(commits(spark, root, at).select("generation"), "generation", "left_semi")
    return joined(rows, gone, [*by, "generation"], "left_anti")


def snapshot(rows: DataFrame) -> str:
    """Digest of a table's rows in whatever order: their number and the sums of two hashes of them."""
    def total(seed: int) -> Column:
        return F.sum(F.xxhash64(F.lit(seed), *rows.columns).cast("decimal(38,0)"))

    return "-".join(str(x) for x in rows.agg(F.count("*"), total(1), total(2)).first())


def verified(rows: DataFrame, key: str, ids: DataFrame | None, fingerprint: str | None) -> None:
    """Raise unless ids are there once each, are those of ``ids``, and carry one fingerprint where the rows have that column."""
    total, different, without = rows.agg(F.count("*"), F.countDistinct(key), F.count_if(F.col(key).isNull())).first()
    if without or total != different:
        raise ValueError(f"{key} isn't unique: {total} rows, {different} ids, {without} null")
    if ids is not None:
        lost = ids.select(key).join(rows.select(key), key, "left_anti").limit(1).count()
        extra = rows.select(key).join(ids.select(key), key, "left_anti").limit(1).count()
        if lost or extra:
            raise ValueError("the ids of the two stores don't agree")
    if fingerprint is not None and "fingerprint" in rows.columns and not rows.where(~F.col("fingerprint").eqNullSafe(F.lit(fingerprint))).isEmpty():
        raise ValueError("rows were made with another configuration")


def write(
    rows: DataFrame,
    root: str,
    by: list[str],
    key: str,
    *,
    removed: DataFrame | None = None,
    base: bool = False,
    expected: int | None = None,
    ids: DataFrame | None = None,
    fingerprint: str | None = None,
    unchanged: Callable[[], bool] | None = None,
) -> int:
    """Replace the files that ``rows`` hold, and all others too if ``base``, remove those in ``removed``, and return the commit's number.

    ``expected`` is the number that the rows were made from. Without ``base`` a later commit only matters if it touched one of
    the same files; with it any later commit does. ``unchanged`` is asked last, before the commit: it says whether
    sources and settings are still those that the rows were made from. A failure at any point leaves the store as it was.
    """
    spark = rows.sparkSession
    files = Files(spark, root)
    start = version(spark, root) if expected is None else expected
    generation = f"g{uuid.uuid4().hex}"
    files.put(f"{root}/journal/{generation}.json", json.dumps({"generation": generation, "began": time.time()}))
    try:
        folder = f"{root}/data/generation={generation}"
        rows.write.parquet(folder)
        staged = spark.read.schema(rows.schema).parquet(folder)
        verified(staged, key, ids, fingerprint)
        actions = staged.groupBy(*by).agg(F.lit(False).alias("removed"), F.count("*").alias("rows"), F.sum(F.xxhash64(key).cast("decimal(38,0)")).alias("digest"))
        if removed is not None:
            gone = joined(removed.select(*by).distinct(), actions, by, "left_anti")
            actions = actions.unionByName(gone.select(*by, F.lit(True).alias("removed"), F.lit(0).cast("long").alias("rows"), F.lit(0).cast("decimal(38,0)").alias("digest")))
        actions.write.parquet(f"{root}/actions/generation={generation}")
        if unchanged is not None and not unchanged():
            raise Conflict("sources or settings have changed since the rows were made")
        number = start + 1
        while not files.put_new(f"{root}/commits/{number:012d}.json", json.dumps({"number": number, "generation": generation, "base": base, "fingerprint": fingerprint})):
            if base or touched(spark, root, generation, number, by):
                raise Conflict(f"commit {number} came first")
            number += 1
    except BaseException:
        taken_back(files, root, generation)
        raise
    files.delete(f"{root}/journal/{generation}.json")
    return number


def touched(spark: SparkSession, root: str, generation: str, number: int, by: list[str]) -> bool:
    """Did commit ``number`` replace everything, or a file of this generation?"""
    other = json.loads(Files(spark, root).text(f"{root}/commits/{number:012d}.json"))
    own, theirs = (spark.read.parquet(f"{root}/actions/generation={g}").select(*by) for g in (generation, other["generation"]))
    return other["base"] or not joined(own, theirs, by, "left_semi").isEmpty()


def taken_back(files: Files, root: str, generation: str) -> None:
    for kind in ("actions", "data"):
        files.delete(f"{root}/{kind}/generation={generation}")
    files.delete(f"{root}/journal/{generation}.json")


def recover(spark: SparkSession, root: str, older_than: float = 3600.0) -> dict[str, bool]:
    """Finish what killed writers left: of each journal entry older than so many seconds, whether its generation had been committed.

    What was committed stays, only its entry goes; what wasn't is deleted. Run it before new writers start, or with an age that
    no write reaches.
    """
    files, out = Files(spark, root), {}
    for name in files.names(f"{root}/journal"):
        if name.startswith("."):
            continue
        entry = json.loads(files.text(f"{root}/journal/{name}"))
        if time.time() - entry["began"] < older_than:
            continue
        generation = entry["generation"]
        done = any(json.loads(files.text(f"{root}/commits/{n:012d}.json"))["generation"] == generation for n in numbers(spark, root))
        if done:
            files.delete(f"{root}/journal/{name}")
        else:
            taken_back(files, root, generation)
        out[generation] = done
    return out


def compact(spark: SparkSession, root: str, by: list[str], key: str) -> int:
    """Write the rows that are there as one new base; a write in between makes it fail."""
    at = version(spark, root)
    return write(read(spark, root, at).drop("generation"), root, by, key, base=True, expected=at)


def vacuum(spark: SparkSession, root: str, at: int) -> list[str]:
    """Delete generations that readers of number ``at`` and later don't need: those of commits before its last base."""
    files = Files(spark, root)
    entries = [json.loads(files.text(f"{root}/commits/{n:012d}.json")) for n in numbers(spark, root)]
    first = max((e["number"] for e in entries if e["base"] and e["number"] <= at), default=0)
    old = [e for e in entries if e["number"] < first]
    for e in old:
        for kind in ("actions", "data"):
            files.delete(f"{root}/{kind}/generation={e['generation']}")
        files.delete(f"{root}/commits/{e['number']:012d}.json")
    return [e["generation"] for e in old]
