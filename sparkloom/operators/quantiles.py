"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def place(p: float, n: Column, nearest: bool) -> tuple[Column, Column, Column]:
    """Positions from 0 of the two values around a quantile of n, and the share of the second."""
    if nearest:
        at = F.greatest(F.ceil(n * p) - 1, F.lit(0)).cast("bigint")
        return at, at, F.lit(0.0)
    h = (n - 1) * F.lit(p)
    return F.floor(h).cast("bigint"), F.ceil(h).cast("bigint"), h - F.floor(h)


def quantiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, tuple[float, bool]]) -> DataFrame:
    """For each group a column for each wanted (share, nearest rank or else linear interpolation) of the values that are not null;
    a group without any has no row.

    No task holds a group: values are counted by narrow classes (0.4 % wide, so some thousands for a group), which tell the
    classes where the wanted positions lie; only values of those are counted one by one and ordered within their class. Repeated
    values are one row by then. NaN is no value, like null; the infinities are values, one class each.
    """
    v = F.col(value).cast("double")
    size = F.when(F.abs(v) == float("inf"), F.lit(1 << 40)).otherwise(F.floor(F.log(F.abs(v)) * 256).cast("bigint"))
    narrow = df.where(v.isNotNull() & ~F.isnan(v)).select(*by, v.alias("_v"), F.signum(v).cast("int").alias("_sign"), F.when(v > 0, size).when(v < 0, -size).otherwise(0).alias("_class"))
    group = Window.partitionBy(*by)
    before = F.sum("_m").over(group.orderBy("_sign", "_class").rowsBetween(Window.unboundedPreceding, -1))
    classes = narrow.groupBy(*by, "_sign", "_class").agg(F.count("*").alias("_m")).withColumn("_before", F.coalesce(before, F.lit(0))).withColumn("_n", F.sum("_m").over(group))
    ranks = F.array_distinct(F.array(*(x for p, near in wanted.values() for x in place(p, F.col("_n"), near)[:2])))
    inside = F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_m")))
    hit = classes.select(*by, "_sign", "_class", "_before", "_n", inside.alias("_ranks")).where(F.size("_ranks") > 0)

    key = [*by, "_sign", "_class"]
    near = narrow.join(hit.select(*(F.col(c).alias(f"_h{i}") for i, c in enumerate(key)), "_before", "_n", "_ranks"), [F.col(c).eqNullSafe(F.col(f"_h{i}")) for i, c in enumerate(key)])
    counted = near.groupBy(*key, "_before", "_n", "_ranks", "_v").agg(F.count("*").alias("_c"))
    end = F.col("_before") + F.sum("_c").over(Window.partitionBy(*key).orderBy("_v"))
    found = counted.withColumn("_end", end).select(*by, "_n", "_v", F.explode(F.filter("_ranks", lambda r: (r >= F.col("_end") - F.col("_c")) & (r < F.col("_end")))).alias("_r"))
    at = found.groupBy(*by, "_n").agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_at"))

    def pick(p: float, nearest: bool) -> Column:
        low, high, part = place(p, F.col("_n"), nearest)
        a, b = F.element_at("_at", low), F.element_at("_at", high)
        return F.when(a == b, a).otherwise(a + (b - a) * part)

    return at.select(*by, *(pick(p, near).alias(name) for name, (p, near) in wanted.items()))
