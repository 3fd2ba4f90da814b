"""Ranked lists: top-k, fusion, diversity and selection. Every order ends in a unique key, so ranks are reproducible."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import log_count, relevance, top_mean

Order = list[Column]


def best_first(score: str, key: str) -> Order:
    return [F.desc(score), F.asc(key)]


def ranked(df: DataFrame, order: Order, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """A rank from 1 within ``by``. Without ``by`` the frame should be a bounded pool: all its rows meet in one task."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*(by or [])).orderBy(*order)))


def top_per(df: DataFrame, by: list[str], order: Order, k: int, name: str = "rank") -> DataFrame:
    """The first k of each group; Spark cuts groups to k rows before and after the exchange."""
    return ranked(df, order, by, name).where(F.col(name) <= k)


def top(df: DataFrame, order: Order, k: int) -> DataFrame:
    """The first k of all, kept in a heap of k in each task, with their rank."""
    return ranked(df.orderBy(*order).limit(k), order)


def latest(df: DataFrame, key: list[str], order: Order) -> DataFrame:
    return top_per(df, key, order, 1, "_r").drop("_r")


def adaptive_k(fetch: int, base: int = 60) -> int:
    return max(base // 3, 10) if fetch <= 10 else max(base // 2, 20) if fetch <= 30 else base


def rrf(paths: list[tuple[DataFrame, float]], key: str, k: int, limit: int) -> DataFrame:
    """Weighted reciprocal rank fusion of (key, rank) lists, each scaled to 1 at its head, over the best; ties to smaller keys."""
    parts = [p.select(key, (F.lit(w) * (k + 1) / (k + F.col("rank"))).alias("s")) for p, w in paths]
    fused = reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.sum("s").alias("s"))
    head = top(fused, best_first("s", key), limit)
    return head.withColumn("score", F.col("s") / F.max("s").over(Window.partitionBy())).drop("s")


def rank_union(paths: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Sum of 1 / (k + rank) over unweighted lists, with the rank in the first as tie-break."""
    parts = [p.select(key, (1.0 / (k + F.col("rank"))).alias("s"), F.when(F.lit(i == 0), F.col("rank")).alias("own")) for i, p in enumerate(paths)]
    return reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.sum("s").alias("score"), F.min("own").alias("own"))


def zigzag(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """What both lists have in the left's order, then the rest of each in turn."""
    both = left.select(key, F.col("rank").alias("l")).join(right.select(key, F.col("rank").alias("r")), key, "full_outer")
    side = F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), 0).when(F.col("r").isNull(), 1).otherwise(2)
    within = F.row_number().over(Window.partitionBy("side").orderBy(F.coalesce("l", "r"), key))
    placed = both.withColumn("side", side).withColumn("n", within)
    order = [F.asc(F.least("side", F.lit(1))), F.asc(F.when(F.col("side") == 0, F.col("n")).otherwise(2 * F.col("n") + F.col("side"))), F.asc(key)]
    return ranked(placed, order).select(key, "rank")


def diversified(df: DataFrame, by: list[str], most: int, order: Order) -> DataFrame:
    """The first ``most`` of each group in order, all others after them."""
    first = ranked(df, order, by, "_n").withColumn("_late", (F.col("_n") > most).cast("int"))
    return ranked(first, [F.asc("_late"), *order], name="rank").drop("_n", "_late")


def guaranteed(df: DataFrame, by: list[str], least: int, k: int, order: Order) -> DataFrame:
    """``least`` of each group, then the best of the rest until there are k, or as many as are guaranteed."""
    first = ranked(df, order, by, "_n").withColumn("_late", (F.col("_n") > least).cast("int"))
    placed = ranked(first, [F.asc("_late"), *order], name="rank").withColumn("_sure", F.sum((F.col("_late") == 0).cast("int")).over(Window.partitionBy()))
    return placed.where(F.col("rank") <= F.greatest(F.col("_sure"), F.lit(k))).drop("_n", "_late", "_sure")


def coverage(df: DataFrame, by: str, score: str, key: str, k: int, floor: float = 0.35) -> DataFrame:
    """Above a share of the top score, one of each group first."""
    above = df.withColumn("_top", F.max(score).over(Window.partitionBy())).where(F.col(score) >= floor * F.col("_top")).drop("_top")
    return guaranteed(above, [by], 1, k, best_first(score, key)).where(F.col("rank") <= k)


def evidence(df: DataFrame, mode: str, threshold: float, order: Order, score: str = "score", protected: Column | None = None) -> DataFrame:
    """Absolute floor, share of the top, or the best part of the list; protected rows always stay."""
    if mode == "absolute":
        keep = F.col(score) >= threshold
    elif mode == "ratio":
        df = df.withColumn("_top", F.max(score).over(Window.partitionBy()))
        keep = F.col(score) >= threshold * F.col("_top")
    elif mode == "percentile":
        df = ranked(df, order, name="_n").withColumn("_all", F.count("*").over(Window.partitionBy()))
        keep = F.col("_n") <= F.greatest(F.round(F.col("_all") * (1 - threshold)), F.lit(1))
    else:
        raise ValueError(mode)
    return df.where(keep | protected if protected is not None else keep).drop("_top", "_n", "_all")


def group_scores(df: DataFrame, by: str, score: str, method: str = "top_k_mean", k: int = 3, blend: float | None = None) -> DataFrame:
    """A score of each group: mean of its k best, its best, or how many are 0.1 and more; with ``blend``, part of it is
    the logarithm of the count."""
    values = F.col(score)
    if method == "top_k_mean":  # only the k best of a group meet
        head = top_per(df, [by], [F.desc(score)], k, "_n").groupBy(by).agg(top_mean(F.collect_list(values), k).alias("quality"))
        out = head.join(df.groupBy(by).agg(F.count("*").alias("n")), by)
    else:
        value = F.max(values) if method == "max" else F.count_if(values >= 0.1).cast("double")
        out = df.groupBy(by).agg(value.alias("quality"), F.count("*").alias("n"))
    return out.withColumn("score", F.col("quality") if blend is None else blend * F.col("quality") + (1 - blend) * log_count(F.col("n")))


def unit_scaled(df: DataFrame, score: str, name: str = "unit", equal: float | None = None) -> DataFrame:
    """Scores from 0 to 1; equal scores become 1, and 0 where none is positive, or ``equal`` where that is given."""
    w = Window.partitionBy()
    low, high = F.min(score).over(w), F.max(score).over(w)
    level = F.when(high <= 0, 0.0).when(high == low, 1.0) if equal is None else F.when(high == low, equal)
    return df.withColumn(name, level.otherwise((F.col(score) - low) / (high - low)))


def knn(df: DataFrame, distance: Column, key: str, k: int, most: float | None = None) -> DataFrame:
    """The k nearest by an expression of a row, with a relevance from the distance."""
    near = df.withColumn("distance", distance)
    near = near if most is None else near.where(F.col("distance") <= most)
    return top(near, [F.asc("distance"), F.asc(key)], k).withColumn("score", relevance(F.col("distance"), True))


def evicted(scope: DataFrame, anchors: DataFrame, key: str, cap: int, quota: int) -> DataFrame:
    """A ranked scope of ``cap`` keys at most; up to ``quota`` anchors that it lacks take the places of its last others."""
    missing = ranked(anchors.select(key).distinct().join(scope, key, "left_anti"), [F.asc(key)], name="n").where(F.col("n") <= quota).select(key, F.lit(0).alias("late"), F.col("n").alias("place"))
    own = scope.select(key, "rank").join(anchors.select(key).distinct().withColumn("a", F.lit(0)), key, "left").select(key, F.coalesce("a", F.lit(1)).alias("late"), F.col("rank").alias("place"))
    kept = ranked(own.unionByName(missing), [F.asc("late"), F.asc("place"), F.asc(key)], name="n").where(F.col("n") <= cap)
    return kept.select(key, F.col("n").alias("rank"))


def best_of_each(df: DataFrame, method: str, score: str, key: str, n: int = 2) -> DataFrame:
    """The n best rows of different methods; where there are fewer methods, the best of the other rows fill up."""
    own = F.row_number().over(Window.partitionBy(method).orderBy(F.desc(score), key))
    return df.withColumn("_own", own).orderBy(F.col("_own") > 1, F.desc(score), method, key).limit(n).drop("_own")
