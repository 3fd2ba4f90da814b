"""Documents whose statistics lie far from those of their language and source.

Counts of a text become a vector of five transformed statistics: logarithms of the number of words and of the mean word
length, and square roots of the shares of symbols, of repeated lines and of repeated word windows. Shares are taken with
``PRIOR`` words or lines more, so that short texts, whose shares vary by chance, move less. For each language and source
the minimum-covariance-determinant estimate of centre and scatter is found by concentration steps, and a document whose
Mahalanobis distance exceeds ``LIMIT`` is rejected.

No group is gathered: vectors are integers (``UNIT`` steps to one), so sums over any split of the rows are exact and
equal. A step is one aggregate: squared distances fall into narrow classes, each class is summed, and the classes up to the
wanted share of the rows, a bounded list for each group, give the next estimate. Different texts count once each, so a
group of exact copies can't pull the estimate; all documents are judged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_arrow, release, with_text, written
from .words import WORD_BASES, Words, ranges, sums

#: Characters that count as symbols, and the base rules: fewest words, and percent of words in repeated windows.
SYMBOLS = b"#*$%&|<>"
FEWEST, REPEATED, WINDOW = 20, 30, 8

UNIT = 256
PRIOR, PRIOR_LENGTH = 20, 5
#: Standard deviations that every group has besides its own: most texts have no symbols or repeats at all, which alone would
#: make any a certain outlier, and lengths differ by nature.
FLOORS = (1.0, 0.05, 0.1, 0.15, 0.15)
DIMENSIONS = len(FLOORS)
PAIRS = list(combinations_with_replacement(range(DIMENSIONS), 2))
#: Share of the rows that an estimate rests on, concentration steps at most, and probability of a distance within LIMIT.
SHARE, STEPS, SURE = 0.75, 12, 0.9999
#: Different texts that an estimate takes; thinner groups share one with the other thin groups of their language.
ENOUGH = 50
#: Classes of squared distance for each doubling.
CLASSES = 32


def chi2(x: float, k: int) -> float:
    """Distribution function of chi-squared with an odd number of degrees of freedom."""
    terms = [math.sqrt(2 * x / math.pi)]
    for i in range(3, k, 2):
        terms.append(terms[-1] * x / i)
    return math.erf(math.sqrt(x / 2)) - math.exp(-x / 2) * sum(terms[: (k - 1) // 2])


def chi2_at(probability: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2(middle, k) < probability else (low, middle)
    return high


LIMIT = chi2_at(SURE, DIMENSIONS)
#: Squared distances within which the last estimate takes its rows.
INNER = chi2_at(0.975, DIMENSIONS)


def too_small(share: float) -> float:
    """By how much the scatter of the nearest ``share`` of normal rows falls short."""
    return chi2(chi2_at(share, DIMENSIONS), DIMENSIONS + 2) / share


def counted(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The counts of UTF-8 texts."""
    words = Words(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    full = np.flatnonzero(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    symbol, inner = np.zeros(256, bool), np.ones(256, bool)
    symbol[list(SYMBOLS)] = True
    inner[[0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)]] = False  # separators, and bytes that go on with a code point

    def per_text(kind: np.ndarray) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        if len(full):
            out[full] = np.add.reduceat(kind[data], (np.cumsum(sizes) - sizes)[full], dtype=np.int64)
        return out

    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    n_lines = np.fromiter(map(len, lines), np.int64, len(texts))
    begin, of = words.windows(WINDOW), words.text_of()
    found = ranges(sums(words.hashes, WORD_BASES[0]), begin, begin + WINDOW, WORD_BASES[0])
    order = np.lexsort((found, of[begin])) if len(begin) else begin
    same = (np.diff(found[order]) == 0) & (np.diff(of[begin][order]) == 0)
    twice = begin[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]] if len(begin) else begin
    edges = np.bincount(twice, minlength=len(of) + 1) - np.bincount(twice + WINDOW, minlength=len(of) + 1)
    repeats = np.bincount(of[np.cumsum(edges)[: len(of)] > 0], minlength=len(texts))
    return {"n_words": words.counts, "word_chars": per_text(inner), "n_symbols": per_text(symbol), "n_dup_lines": n_lines - np.fromiter((len(set(x)) for x in lines), np.int64, len(texts)), "n_repeat_words": repeats, "n_lines": n_lines}


def vector(c: dict[str, np.ndarray]) -> list[np.ndarray]:
    """The transformed statistics in steps of 1 / UNIT."""
    n = c["n_words"] + PRIOR
    shares = [c["n_symbols"] / n, c["n_dup_lines"] / (c["n_lines"] + PRIOR), c["n_repeat_words"] / n]
    values = [np.log(n), np.log((c["word_chars"] + PRIOR * PRIOR_LENGTH) / n), *map(np.sqrt, shares)]
    return [np.rint(x * UNIT).astype(np.int64) for x in values]


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
AXES = [f"x{i}" for i in range(DIMENSIONS)]


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed, the vector and a 64-bit hash of the text, for each row of ``documents``.
    Null text has no words, as has empty text; both fail. Long texts are counted whole, repeated rows give equal rows."""
    schema = ", ".join(["doc_id long", "lang string", "source string", "seen long", *(f"{x} long" for x in COUNTS + AXES)])
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            counts = counted(part.column("text").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(x) for x in names[:4]] + [pa.array(x) for x in [*(counts[c] for c in COUNTS), *vector(counts)]], names)

    text = with_text(documents, F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")).withColumn("seen", F.xxhash64("text"))
    failed = (F.col("n_words") < FEWEST) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEATED)
    return map_arrow(text, work, schema).withColumn("base_failed", failed)


def keys(texts: DataFrame) -> DataFrame:
    """lang, source and key, the name of the estimate for it: its own if it has ENOUGH different texts, else that of its
    language's thin groups, else that of all thin groups left; null where even those are too few. One row a group, so
    the tables joined here are small; null is a language and a source like any other."""
    own = texts.groupBy("lang", "source").agg(F.count("*").alias("n"))
    thin = own.where(F.col("n") < ENOUGH)
    of_lang = thin.groupBy(F.col("lang").alias("of")).agg(F.sum("n").alias("n_lang"))
    rest = of_lang.where(F.col("n_lang") < ENOUGH).agg(F.sum("n_lang").alias("n_rest"))
    name = F.when(F.col("n") >= ENOUGH, F.to_json(F.struct("lang", "source"))).when(F.col("n_lang") >= ENOUGH, F.concat(F.lit("thin "), F.to_json(F.struct("lang")))).when(F.col("n_rest") >= ENOUGH, F.lit("thin"))
    return own.join(of_lang, F.col("lang").eqNullSafe(F.col("of")), "left").join(F.broadcast(rest)).select("lang", "source", name.alias("key"))


def with_key(rows: DataFrame, named: DataFrame) -> DataFrame:
    other = named.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *(c for c in named.columns if c not in ("lang", "source")))
    return rows.join(other, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left").drop("_lang", "_source")


MODEL = "key string, start int, size long, center array<double>, precision array<double>, logdet double"


def model(key: str, start: int, size: int, center: np.ndarray, scatter: np.ndarray) -> tuple:
    """A row of MODEL; the precision is that of steps of 1 / UNIT, by pairs, those off the diagonal twice."""
    full = scatter + np.diag(np.square(np.array(FLOORS) * UNIT))
    inverse = np.linalg.inv(full)
    return key, start, size, center.tolist(), [inverse[i, j] * (1 if i == j else 2) for i, j in PAIRS], float(np.linalg.slogdet(full)[1])


def moments(n: int, first: list[int], second: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from exact sums."""
    center = np.array([x / n for x in first])
    scatter = np.zeros((DIMENSIONS, DIMENSIONS))
    for (i, j), x in zip(PAIRS, second):
        scatter[i, j] = scatter[j, i] = (x * n - first[i] * first[j]) / (n * n)
    return center, scatter


def distance() -> Column:
    """Squared Mahalanobis distance from columns of the vector, center and precision."""
    off = [F.col(x) - F.col("center")[i] for i, x in enumerate(AXES)]
    out = F.lit(0.0)
    for k, (i, j) in enumerate(PAIRS):
        out = out + F.col("precision")[k] * off[i] * off[j]
    return F.greatest(out, F.lit(0.0))


def totals() -> list[Column]:
    """Exact sums of rows with a weight; a sum too large for a long fails instead of going wrong (2e11 texts a group fit)."""
    sums_of = [F.sum(F.col("w") * F.col(x)).alias(f"s{i}") for i, x in enumerate(AXES)]
    return [F.sum("w").alias("n"), *sums_of, *(F.sum(F.col("w") * F.col(AXES[i]) * F.col(AXES[j])).alias(f"q{i}{j}") for i, j in PAIRS)]


FIRST, SECOND = [f"s{i}" for i in range(DIMENSIONS)], [f"q{i}{j}" for i, j in PAIRS]


def starts(vectors: DataFrame) -> DataFrame:
    """Two first estimates of each key: mean and covariance of all rows, and medians with their absolute deviations.

    Medians come from counts of the values of each axis, of which there are a few thousand.
    """

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        r = rows.iloc[0]
        return frame([model(r.key, 0, int(r.n), *moments(int(r.n), [int(r[x]) for x in FIRST], [int(r[x]) for x in SECOND]))])

    def medians(rows: pd.DataFrame) -> pd.DataFrame:
        center, spread = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
        for axis, own in rows.groupby("axis"):
            center[axis] = middle(own.value.to_numpy(), own.n.to_numpy())
            spread[axis] = 1.4826 * middle(np.abs(own.value.to_numpy() - center[axis]), own.n.to_numpy())
        return frame([model(rows.key.iloc[0], 1, int(rows.n.sum()) // DIMENSIONS, center, np.diag(spread**2))])

    axes = F.explode(F.array(*(F.struct(F.lit(i).alias("axis"), F.col(x).alias("value")) for i, x in enumerate(AXES)))).alias("a")
    values = vectors.select("key", "w", axes).groupBy("key", "a.axis", "a.value").agg(F.sum("w").alias("n"))
    return vectors.groupBy("key").agg(*totals()).groupBy("key").applyInPandas(whole, MODEL).unionByName(values.groupBy("key").applyInPandas(medians, MODEL))


def middle(values: np.ndarray, weights: np.ndarray) -> float:
    """The smallest value up to which half of the weight lies."""
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(weights[order])
    return float(values[order][np.searchsorted(2 * upto, upto[-1])])


def frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in MODEL.split(", ")])


def concentrated(vectors: DataFrame, models: DataFrame, within: float | None = None) -> DataFrame:
    """Each estimate again from the nearest SHARE of its rows, or from those within a squared distance.

    All rows of the class of distances in which SHARE is reached belong, so ties stay together.
    """

    def again(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("near")
        size = int(rows.n.sum())
        if within is None:
            taken = rows.iloc[: int(np.searchsorted(rows.n.cumsum().to_numpy(), SHARE * size)) + 1]
        else:
            taken = rows[rows.near <= math.floor(CLASSES * math.log2(within))]
        n = int(taken.n.sum())
        r = rows.iloc[0]
        if not n:
            return frame([])
        center, scatter = moments(n, [int(taken[x].sum()) for x in FIRST], [int(taken[x].sum()) for x in SECOND])
        return frame([model(r.key, int(r.start), size, center, scatter / too_small(min(n / size, 0.999) if within is None else 0.975))])

    near = F.floor(F.log2(F.greatest(F.col("d2"), F.lit(2.0**-10))) * CLASSES)
    sized = vectors.join(models.select("key", "start", "center", "precision"), "key").withColumn("d2", distance())
    return sized.groupBy("key", "start", near.alias("near")).agg(*totals()).groupBy("key", "start").applyInPandas(again, MODEL)


def estimates(vectors: DataFrame) -> DataFrame:
    """center and precision of each key, from rows of key, the vector and w, how many different texts have it."""
    models = written(starts(vectors), "models")
    for _ in range(STEPS):
        after = written(concentrated(vectors, models), "models")
        unchanged = after.join(models.select("key", "start", F.col("center").alias("was")), ["key", "start"]).where(F.col("center") != F.col("was")).isEmpty()
        release(models)
        models = after
        if unchanged:
            break
    best = models.groupBy("key").agg(F.min_by(F.struct("start", "size", "center", "precision", "logdet"), F.struct("logdet", "start")).alias("m")).select("key", "m.*")
    last = written(concentrated(vectors, best, INNER), "models")
    release(models)
    return last


def judge(documents: DataFrame) -> DataFrame:
    """Each row's statistics, base_failed, distance and kept.

    ``distance`` is the squared Mahalanobis distance from the estimate of its language and source, 0 where all groups
    together have fewer than ENOUGH texts; ``kept`` says that the base rules hold and it is at most LIMIT. Estimates are made
    from the different texts that the base rules keep. Null and empty texts fail the base rules. Null is a language and a
    source. Repeated rows get one verdict; an empty table gives none. Of extra columns none is read.
    """
    rows = written(statistics(documents), "statistics")
    texts = rows.where("not base_failed").groupBy("lang", "source", "seen", *AXES).agg(F.lit(1).alias("one"))
    named = written(keys(texts), "keys")
    vectors = written(with_key(texts, named).where("key is not null").groupBy("key", *AXES).agg(F.count("*").alias("w")), "vectors")
    models = estimates(vectors)
    release(vectors)
    found = named.join(models.select("key", "center", "precision"), "key", "left").drop("key")
    out = with_key(rows, found).withColumn("distance", F.coalesce(distance(), F.lit(0.0)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= LIMIT)).drop("center", "precision", "seen", *AXES)
