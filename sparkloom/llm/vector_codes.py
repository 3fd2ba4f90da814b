"""Vectors as short codes: each part of a vector is the number of its nearest codebook entry.

Components become integers and all distances are exact. The nearest entry is found coarse to fine: with blocks of
components replaced by their means, the squared distance is at least the sum over blocks of length times squared
difference of means, plus the squared difference of the norms of what the means leave over. Entries whose bound, less
what floating point may err, exceeds an exact distance already known are out; the rest get exact integer distances.

Codebooks are bounded (parts times entries) and live on the driver; sums of assigned parts are made within a task and
then by exchange, so neither a common vector nor a common label gathers in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Numbers of blocks of the bounds, coarse to fine; the last leaves blocks of one component where parts have 16.
BLOCKS = (1, 4, 16)
#: Up to so many entries left, exact distances cost less than a finer bound.
FEW = 6
#: Rows whose bounds are computed at a time.
ROWS = 1024
#: Up to this size of components int64 holds every distance and the bounds' errors stay below the margin.
NARROW = 1 << 26
#: Components are held within this, which only those of 4e15 and more in the vector exceed.
WIDEST = 1 << 62
LONG = (1 << 63) - 1


def bounds_of(length: int, pieces: int) -> np.ndarray:
    """Where ``pieces`` consecutive pieces of ``length`` positions begin and end; they are equal where they can be."""
    return np.arange(pieces + 1) * length // pieces


def sketch(x: np.ndarray, blocks: int) -> np.ndarray:
    """Each row as block means, times the root of their lengths, and the norm of what they leave over: the squared distance
    of two rows' sketches is at most that of the rows."""
    cuts = np.unique(bounds_of(x.shape[1], blocks))
    sizes = np.diff(cuts)
    means = np.add.reduceat(x, cuts[:-1], axis=1) / sizes
    rest = np.sqrt(((x - np.repeat(means, sizes, axis=1)) ** 2).sum(axis=1))
    return np.concatenate([means * np.sqrt(sizes), rest[:, None]], axis=1)


class Book:
    """One part's codebook with the sketches of its entries."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.wide = entries.dtype == object
        narrow = not self.wide and entries.size
        self.shift = entries.sum(axis=0) // len(entries) if narrow else 0  # distances stay, rounding errors shrink
        self.sketches = [sketch(entries - self.shift, b) for b in BLOCKS] if narrow else []
        self.squares = [(z**2).sum(axis=1) for z in self.sketches]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row the nearest entry (the lowest of equals), its squared distance and how many exact distances that took."""
        if not x.shape[1]:
            return tuple(np.zeros(len(x), np.int64) for _ in range(3))
        if self.wide or x.dtype == object:
            far = np.stack([((x.astype(object) - e) ** 2).sum(axis=1) for e in self.entries.astype(object)], axis=1)
            at = np.array([min(range(far.shape[1]), key=row.__getitem__) for row in far], np.int64)
            return at, far[np.arange(len(x)), at], np.full(len(x), far.shape[1])
        alive = np.ones((len(x), len(self.entries)), bool)
        best = np.full(len(x), np.iinfo(np.int64).max)
        looked = np.zeros(len(x), np.int64)
        open_ = np.arange(len(x))
        for blocks, z, squares in zip(BLOCKS, self.sketches, self.squares):
            own = sketch(x[open_] - self.shift, blocks)
            square = (own**2).sum(axis=1)
            low = square[:, None] + squares - 2 * (own @ z.T)
            exact = ((x[open_] - self.entries[low.argmin(axis=1)]) ** 2).sum(axis=1)
            best[open_] = np.minimum(best[open_], exact)
            looked[open_] += 1
            margin = best[open_] * (1 + 1e-6) + 1.0 + 2.0**-46 * (square + squares.max())
            alive[open_] &= low <= margin[:, None]
            open_ = open_[np.count_nonzero(alive[open_], axis=1) > FEW]
            if not len(open_):
                break
        rows, cols = np.nonzero(alive)
        exact = ((x[rows] - self.entries[cols]) ** 2).sum(axis=1)
        firsts = np.searchsorted(rows, np.arange(len(x)))
        least = np.minimum.reduceat(exact, firsts)
        hits = np.flatnonzero(exact == least[rows])
        return cols[hits[np.searchsorted(rows[hits], np.arange(len(x)))]], least, looked + np.bincount(rows, minlength=len(x))


def integers(column: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) of a column of vectors of one length, int64 or, where those are too large, Python's integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width) * SCALE
    if not flat.size or np.abs(flat).max() < NARROW:
        return np.floor(flat).astype(np.int64)
    return np.array([[min(max(int(np.floor(v)), -WIDEST), WIDEST) if np.isfinite(v) else (WIDEST if v > 0 else -WIDEST) for v in row] for row in flat], object).reshape(flat.shape)


def usable(embeddings: DataFrame) -> DataFrame:
    """Rows whose vector is there and has only finite components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.where(F.col("embedding").isNotNull() & finite).select("vec_id", "label", "embedding")


def batches_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, integers(part.column("embedding"), width)


def books_of(codebooks: list[np.ndarray]) -> list[Book]:
    return [Book(x) for x in codebooks]


def moved(vectors: DataFrame, codebooks: list[np.ndarray], cuts: np.ndarray) -> list[np.ndarray]:
    """The codebooks with each entry at the floor of the mean of the parts nearest to it; entries that none is nearest to stay."""
    width = int(cuts[-1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = books_of(codebooks)
        sums = [np.zeros(x.shape, np.int64) for x in codebooks]
        counts = [np.zeros(len(x), np.int64) for x in codebooks]
        for _, x in batches_of(batches, width):
            for p, book in enumerate(books):
                own = x[:, cuts[p] : cuts[p + 1]]
                at, _, _ = book.nearest(own)
                if own.dtype == object and sums[p].dtype != object:
                    sums[p] = sums[p].astype(object)
                np.add.at(sums[p], at, own)
                counts[p] += np.bincount(at, minlength=len(counts[p]))
        for p, total in enumerate(sums):
            entry, position = np.nonzero(np.repeat(counts[p][:, None] > 0, total.shape[1], axis=1))
            values = total[entry, position]
            exact = pa.array([int(v) for v in values], pa.decimal128(38, 0)) if total.dtype == object else pa.array(values, pa.int64()).cast(pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), p), pa.int32()), pa.array(entry, pa.int32()), pa.array(position, pa.int32()), exact, pa.array(counts[p][entry])], ["part", "entry", "position", "total", "n"])

    sums = map_arrow(vectors.select("embedding"), work, "part int, entry int, position int, total decimal(38,0), n long")
    out = [x.astype(object) for x in codebooks]
    for row in sums.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        out[row.part][row.entry, row.position] = int(row.total) // row.n
    return [narrowed(x) for x in out]


def narrowed(entries: np.ndarray) -> np.ndarray:
    """int64 if all components are small enough for int64 distances."""
    return entries.astype(np.int64) if not entries.size or max(abs(int(v)) for v in entries.ravel()) < NARROW else entries.astype(object)


def encode(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code, error and n_exact of each usable vector, and the codebooks.

    Rows whose vector is null or holds null or non-finite components take no part, nor do those of another length than the
    vector of the smallest id, with which they can't be compared. The first codebooks are the parts of the ``entries``
    smallest ids (null ids last; among rows of one id the smaller vector first), fewer if there are fewer rows. A length
    that ``parts`` doesn't divide gives parts that differ by one. Repeated rows give equal rows, equal entries leave all but
    the first unused. error is the exact squared distance, at most 2**63 - 1; n_exact counts the exact distances
    that the row took. An empty table has no rows and empty codebooks.
    """
    kept = usable(embeddings)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(1).select(F.size("embedding").alias("n")).collect()
    width = first[0].n if first else 0
    vectors = kept.where(F.size("embedding") == width)
    cuts = bounds_of(width, parts)
    start = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    whole = integers(pa.array([list(r.embedding) for r in start], pa.list_(pa.float64())), width) if width else np.zeros((len(start), 0), np.int64)
    codebooks = [narrowed(whole[:, cuts[p] : cuts[p + 1]]) for p in range(parts)]
    for _ in range(rounds if width else 0):
        codebooks = moved(vectors, codebooks, cuts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = books_of(codebooks)
        for part, x in batches_of(batches, width):
            found = [book.nearest(x[:, cuts[p] : cuts[p + 1]]) for p, book in enumerate(books)]
            codes = ["".join(f"{k:02x}" for k in row) for row in zip(*(at.tolist() for at, _, _ in found))]
            errors = [min(sum(row), LONG) for row in zip(*(far.tolist() for _, far, _ in found))]
            exact = sum(n for _, _, n in found)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array(codes, pa.string()), pa.array(errors, pa.int64()), pa.array(exact, pa.int64())], ["vec_id", "label", "code", "error", "n_exact"])

    schema = T.StructType([*vectors.select("vec_id", "label").schema, T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), T.StructField("n_exact", T.LongType())])
    return map_arrow(vectors, work, schema), codebooks


def digest(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all components, in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(int(v)) for x in codebooks for v in x.ravel()).encode()).hexdigest()


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` and label_error, the sum of error over the rows of an equal label, nulls together; at most 2**63 - 1.

    The sums are one row a label; where they are too many to be sent to every task, a label with very many rows is split by
    the adaptive join.
    """
    codes = written(codes, "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    sums = codes.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of", "label")
