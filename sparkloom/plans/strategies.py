"""Presets and registries: retrieval profiles, scoping strategies, and the functions that a model would give."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ranking


@dataclass(frozen=True)
class Profile:
    top_k: int = 8
    fetch: int = 6
    alpha: float = 0.5
    rrf_k: int = 60
    rerank_top: int = 16
    per_meeting: int = 5
    per_file: int = 3
    scope_cap: int = 8
    evidence: float = 0.15
    mode: str = "ratio"
    memory: str = "balanced"


BALANCED = Profile()
PROFILES = {"balanced": BALANCED, "fast": replace(BALANCED, fetch=3, rerank_top=8), "thorough": replace(BALANCED, top_k=12, fetch=8, rerank_top=24, scope_cap=12)}
MEMORY = ("off", "focused", "balanced", "deep")


def profile(name: str = "balanced", memory: str = "balanced") -> Profile:
    if memory not in MEMORY:
        raise ValueError(memory)
    return replace(PROFILES[name], memory=memory)


def router_only(router: DataFrame, funnel: DataFrame, cap: int) -> DataFrame:
    return router.where(F.col("rank") <= cap).select("file", "rank")


def funnel_only(router: DataFrame, funnel: DataFrame, cap: int) -> DataFrame:
    return funnel.where(F.col("rank") <= cap).select("file", "rank")


def router_pre_filter(router: DataFrame, funnel: DataFrame, cap: int) -> DataFrame:
    return ranking.ranked(funnel.join(router.select("file"), "file", "left_semi"), [F.asc("rank")], name="r").where(F.col("r") <= cap).select("file", F.col("r").alias("rank"))


def router_and_funnel(router: DataFrame, funnel: DataFrame, cap: int) -> DataFrame:
    both = ranking.rank_union([router, funnel], "file").withColumn("s", F.round("score", 12))
    return ranking.top(both, [F.desc("s"), F.coalesce("own", F.lit(1 << 30)).asc(), F.asc("file")], cap).select("file", "rank")


SCOPING: dict[str, Callable[[DataFrame, DataFrame, int], DataFrame]] = {f.__name__: f for f in (router_and_funnel, funnel_only, router_pre_filter, router_only)}
MODELS: dict[str, Callable] = {}


def register_model(name: str):
    """Decorator: make a model known by name; embedders, rerankers and generators are all given to the engine so."""

    def known(f: Callable) -> Callable:
        MODELS[name] = f
        return f

    return known


@register_model("hash-embedding")
def hash_embedding(text: str, width: int = 64) -> list[float]:
    """Deterministic and offline: signed counts of hashed words, of unit length."""
    v = np.zeros(width)
    for w in text.lower().split():
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        v[h % width] += 1 if h >> 63 else -1
    n = float(np.linalg.norm(v))
    return (v / n if n else v).tolist()


def embedded(text: Column, model: str = "hash-embedding") -> Column:
    f = MODELS[model]

    @F.pandas_udf("array<double>")
    def g(s: pd.Series) -> pd.Series:
        return s.fillna("").map(f)

    return g(text)


@register_model("overlap")
def overlap(query: str, text: Column) -> Column:
    """Share of the query's words that a text has. A scorer gives a column; one that isn't built in wraps a pandas UDF."""
    words = sorted(set(query.lower().split()))
    own = F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+")
    return F.size(F.array_intersect(F.array(*map(F.lit, words)), own)) / len(words) if words else F.lit(0.0)


def reranked(
    pool: DataFrame, query: str, key: str, text: str, k: int | Column, least: float = 0.05, model: str = "overlap", by: list[str] | None = None, file: str | None = None, per_file: int = 0
) -> DataFrame:
    """The best of the bounded pool of each request (``by``) by a pair scorer. Of a pool of 1.5 k or more half is kept; scores
    below ``least`` go, but if none reaches it, the first k stay. With ``per_file`` the whole pool is ranked, so many of each
    file come first, then others by score until there are k."""
    by = by or []
    whole, best = Window.partitionBy(*by), ranking.best_first("score", key)
    k = F.lit(k) if isinstance(k, int) else k
    scored = pool.withColumn("score", F.round(MODELS[model](query, F.col(text)), 6)).withColumn("_k", k).withColumn("_n", F.count("*").over(whole)).withColumn("_best", F.max("score").over(whole))
    wide = F.col("_n") if per_file else F.when(F.col("_n") >= 1.5 * F.col("_k"), F.greatest(F.col("_k"), F.floor(F.col("_n") / 2))).otherwise(F.col("_k"))
    kept = ranking.ranked(scored, best, by).where(F.col("rank") <= wide).where((F.col("score") >= least) | ((F.col("_best") < least) & (F.col("rank") <= F.col("_k"))))
    if per_file:
        late = ranking.ranked(kept, best, [*by, file], "_i").withColumn("_late", (F.col("_i") > per_file).cast("int"))
        placed = ranking.ranked(late, [F.asc("_late"), *best], by).withColumn("_sure", F.sum(1 - F.col("_late")).over(whole))
        kept = placed.where(F.col("rank") <= F.greatest("_k", "_sure")).drop("_i", "_late", "_sure")
    return kept.drop("_k", "_n", "_best")


def snapshot(p: Profile) -> str:
    return "|".join(f"{k}={v}" for k, v in sorted(asdict(p).items()))


def caption_and_ocr(caption: Column, ocr: Column) -> Column:
    """Keep both where the recognised text has digits or is twice as long; drop it where it says the same."""
    same = F.lower(F.trim(caption)) == F.lower(F.trim(ocr))
    return F.when(ocr.isNull() | same, "caption").when(ocr.rlike("[0-9]") | (F.length(ocr) > 2 * F.length(caption)), "both").otherwise("model")


def selected(name: str, available: dict[str, Callable]) -> Callable:
    """The retrieval strategy of a name; a name that isn't available falls back to hybrid, then to vector search."""
    for choice in (name, "hybrid", "vector"):
        if choice in available:
            return available[choice]
    raise ValueError(f"no retrieval strategy for {name}")
