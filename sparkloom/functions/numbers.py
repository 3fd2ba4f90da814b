"""Scores, decay and retrieval metrics as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def relevance(raw: Column, lower_is_better: bool) -> Column:
    """A distance d becomes 1 / (1 + d), 0 where 1 + d isn't positive; a relevance stays."""
    return F.when(1 + raw > 0, 1 / (1 + raw)).otherwise(0.0) if lower_is_better else raw


def clamped(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def days_between(late: Column, early: Column) -> Column:
    return (F.unix_timestamp(late.cast("timestamp")) - F.unix_timestamp(early.cast("timestamp"))) / 86400.0


def decay(importance: Column, last: Column, as_of: Column, expires: Column | None = None, rate: float = 0.01, ttl_days: float = 90, unknown_days: float = 365) -> Column:
    """importance * exp(-rate * days); 0 once expired or idle for longer than ttl_days. Without a time it is unknown_days old."""
    age = F.coalesce(days_between(as_of, last), F.lit(float(unknown_days)))
    gone = (age > ttl_days) if expires is None else ((age > ttl_days) | F.coalesce(expires <= as_of, F.lit(False)))
    return F.when(gone, 0.0).otherwise(importance * F.exp(-rate * F.greatest(age, F.lit(0.0))))


def weighted_average(parts: list[tuple[float, Column]]) -> Column:
    return sum((w * clamped(c) for w, c in parts), F.lit(0.0)) / sum(w for w, _ in parts)


def log_count(n: Column) -> Column:
    return F.log1p(n) / math.log(9)


def top_mean(scores: Column, k: int) -> Column:
    best = F.slice(F.sort_array(scores, False), 1, k)
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(best), F.lit(1))


def recall_at(found: Column, wanted: Column, k: int) -> Column:
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(F.slice(found, 1, k), wanted)) / F.size(wanted)).otherwise(0.0)


def precision_at(found: Column, wanted: Column, k: int) -> Column:
    top = F.array_distinct(F.slice(found, 1, k))
    return F.when(F.size(top) > 0, F.size(F.array_intersect(top, wanted)) / F.size(top)).otherwise(0.0)


def reciprocal_rank(found: Column, wanted: Column) -> Column:
    first = F.array_position(F.transform(found, lambda x: F.array_contains(wanted, x)), True)
    return F.when(first > 0, 1.0 / first).otherwise(0.0)


def ndcg_at(found: Column, wanted: Column, k: int) -> Column:
    gains = F.transform(F.slice(found, 1, k), lambda x, i: F.when(F.array_contains(wanted, x), 1 / F.log2(i + 2)).otherwise(0.0))
    ideal = F.transform(F.slice(wanted, 1, k), lambda x, i: 1 / F.log2(i + 2))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(wanted) > 0, total(gains) / total(ideal)).otherwise(0.0)
