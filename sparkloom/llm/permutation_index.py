"""Approximate nearest neighbours by a permutation index.

Each vector is represented by its nearest pivots in order. These orders are posted in inverted files: for each pivot,
the vectors of a segment that have it and its place in their orders. A query reads the lists of its own nearest pivots, adds
up Spearman's footrule (a pivot that an order lacks is at the place after its last), takes the vectors of least footrule as
candidates, and ranks those by their Euclidean distance in double precision.

The pivots come from a bounded sample; every vector is indexed. Candidates are a share of each segment, so they grow with
the table, and besides every vector whose footrule is about that of the nearest, so a dense group counts as a whole.
Queries meet segments in large blocks: what moves is in proportion to the rows for each block of queries.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, written

#: Pivots, those of an order, and vectors from which pivots are chosen, at most.
PIVOTS, NEAREST, SAMPLE = 256, 64, 2048
#: Bytes of the vectors of a segment, its vectors at most, and queries of a block, about.
SEGMENT, MOST, BLOCK = 1 << 23, 1 << 15, 2048
#: Share of a segment that becomes candidates, candidates at least, and the part of the largest footrule within which vectors
#: count as near as the nearest ones.
SHARE, LEAST, CLOSE = 0.1, 64, 0.05
INDEX = "segment long, pivot int, members binary, places binary, vectors binary, ids array<array<long>>"


def chosen_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Vectors of the sample, each as far as possible from those before."""
    if not len(sample):
        return sample
    at, far = [0], np.linalg.norm(sample - sample[0], axis=1)
    while len(at) < min(n, len(sample)):
        at.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(sample - sample[at[-1]], axis=1))
    return sample[at]


def orders(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The nearest pivots of each vector, nearest first."""
    d = (x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * x @ pivots.T
    return np.argsort(d, axis=1, kind="stable")[:, :NEAREST]


def lists(order: np.ndarray, pivots: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pivot the rows that have it, and its places there."""
    n, m = order.shape
    flat = order.ravel()
    by_pivot = np.argsort(flat, kind="stable")
    cuts = np.searchsorted(flat[by_pivot], np.arange(1, pivots))
    rows, places = np.repeat(np.arange(n, dtype=np.uint16), m)[by_pivot], np.tile(np.arange(m, dtype=np.uint8), n)[by_pivot]
    return list(zip(np.split(rows, cuts), np.split(places, cuts)))


def agreement(posted: dict[int, np.ndarray], order: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the sum over pivots of the smaller of the two closenesses, NEAREST less place. Footrule is twice
    that less than the largest, so rows with more agreement have a smaller footrule."""
    out = np.zeros(n, np.uint16)
    for place, p in enumerate(order.tolist()):
        if p in posted:
            out += np.minimum(posted[p], np.uint8(len(order) - place))
    return out


def nearest(found: np.ndarray, x: np.ndarray, ids: list[np.ndarray], query: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest (distance, id) of a segment by footrule, then distance."""
    n = min(len(x), max(LEAST, int(np.ceil(SHARE * len(x)))))
    ordered = np.partition(found, [len(x) - n, len(x) - min(k, len(x))])
    least = min(float(ordered[len(x) - n]), float(ordered[len(x) - min(k, len(x))]) - CLOSE * m * (m + 1) / 2)
    candidates = np.flatnonzero(found >= least)
    distance = np.sqrt(((x[candidates] - query) ** 2).sum(1))
    if len(candidates) > k:
        some = np.flatnonzero(distance <= np.partition(distance, k - 1)[k - 1])
        candidates, distance = candidates[some], distance[some]
    each = [len(ids[c]) for c in candidates]
    flat, far = np.concatenate([ids[c] for c in candidates]), np.repeat(distance, each)
    order = np.lexsort((flat, far))[:k]
    return far[order], flat[order]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of rows that take part: not null, finite, not zero.

    A vec_id that repeats counts once, with the smallest of its vectors.
    """
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = vectors.where(F.col("vec_id").isNotNull() & e.isNotNull() & ~bad & F.exists(e, lambda x: x != 0)).select("vec_id", e.cast("array<double>").alias("embedding"))
    return some.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def build(vectors: DataFrame, k: int) -> tuple[DataFrame, np.ndarray, int]:
    """The inverted files, the pivots, and how many segments there are, of vectors of one length.

    A segment has a row for each pivot, its list, and one row (pivot -1) with the vectors themselves. Equal vectors are one,
    with the k smallest ids that have it (no other can be among the k nearest of anything).
    """
    spark = vectors.sparkSession
    least = lambda c: F.slice(F.array_sort(c), 1, k)
    salted = vectors.groupBy("embedding", F.pmod(F.xxhash64("vec_id"), F.lit(256)).alias("salt")).agg(least(F.collect_list("vec_id")).alias("ids"))
    distinct = written(salted.groupBy("embedding").agg(least(F.flatten(F.collect_list("ids"))).alias("ids")), "vectors")
    sample = np.array([r["embedding"] for r in distinct.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(SAMPLE).collect()])  # bounded by SAMPLE
    pivots = chosen_pivots(sample)
    segments = max(1, -(-distinct.count() // min(MOST, max(1, SEGMENT // (8 * sample.shape[1])))))
    shared = spark.sparkContext.broadcast(pivots)

    def post(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        x = rows.column("embedding").combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
        found = lists(orders(x, shared.value), len(shared.value))
        columns = [[-1, *range(len(found))], [None, *(r.tobytes() for r, _ in found)], [None, *(p.tobytes() for _, p in found)], [x.tobytes()] + [None] * len(found), [rows.column("ids").to_pylist()] + [None] * len(found)]
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.list_(pa.int64()))]
        return pa.Table.from_arrays([pa.array([rows.column("segment")[0].as_py()] * (len(found) + 1), pa.int64()), *(pa.array(c, t) for c, t in zip(columns, kinds))], [x.split()[0] for x in INDEX.split(", ")])

    ship(spark)
    # A segment is bounded by MOST and by what one group of Spark's may hold; hashes deal vectors evenly, with room to spare.
    dealt = distinct.withColumn("segment", F.pmod(F.xxhash64("embedding"), F.lit(segments)))
    return written(dealt.groupBy("segment").applyInArrow(post, INDEX), "index"), pivots, segments


def search_alike(rows: DataFrame, is_query, k: int) -> DataFrame:
    """``search`` among usable rows of one length."""
    spark = rows.sparkSession
    index, pivots, segments = build(rows, k + 1)
    queries = rows.where(is_query)
    asked = written(queries.groupBy("embedding").agg(F.min("vec_id").alias("q")), "asked")
    blocks = max(1, -(-asked.count() // BLOCK))
    shared = spark.sparkContext.broadcast(pivots)
    # The stated query set meets all rows in blocks: each pair of a block and a segment is one group.
    left = asked.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks))).withColumn("segment", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(segments - 1).cast("long"))))
    right = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    most = k + 1

    def answer(own: pa.Table, posted: pa.Table) -> pa.Table:
        found = ([], [], [])
        if len(own) and len(posted):
            query = own.column("embedding").combine_chunks().flatten().to_numpy().reshape(len(own), -1)
            order = orders(query, shared.value)
            whole = posted.column("pivot").to_pylist().index(-1)
            ids = [np.asarray(v) for v in posted.column("ids")[whole].as_py()]
            x = np.frombuffer(posted.column("vectors")[whole].as_py()).reshape(len(ids), -1)
            inverted = {}
            for p, members, places in zip(posted.column("pivot").to_pylist(), posted.column("members").to_pylist(), posted.column("places").to_pylist()):
                if members:
                    inverted[p] = np.zeros(len(ids), np.uint8)
                    inverted[p][np.frombuffer(members, np.uint16)] = order.shape[1] - np.frombuffer(places, np.uint8)
            for q, vector, own_order in zip(own.column("q").to_pylist(), query, order):
                far, near = nearest(agreement(inverted, own_order, len(ids)), x, ids, vector, most, order.shape[1])
                for column, values in zip(found, (np.full(len(near), q), near, far)):
                    column.append(values)
        return pa.Table.from_arrays([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.float64()))], ["q", "vec_id", "score"])

    local = left.groupBy("block", "segment").cogroup(right.groupBy("block", "segment")).applyInArrow(answer, "q long, vec_id long, score double")
    by_score = Window.partitionBy("q").orderBy("score", "vec_id")
    best = local.withColumn("r", F.row_number().over(by_score)).where(F.col("r") <= most).select("q", "vec_id", "score")
    same = queries.select(F.col("vec_id").alias("query_id"), "embedding").join(asked.select("embedding", "q"), "embedding").select("query_id", "q")
    ranked = same.join(best, "q").where("vec_id <> query_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest vectors of each query, ties to smaller ids.

    ``is_query`` is a condition on vec_id. A query's own row is no candidate; with fewer candidates all are returned.
    Rows without a usable vector take no part as query or candidate; vectors of different lengths have no distance, so each
    length is searched by itself, as a table holds one or few. An empty table gives an empty result.
    """
    rows = written(usable(vectors), "usable")
    lengths = [r["n"] for r in rows.select(F.size("embedding").alias("n")).distinct().orderBy("n").collect()]
    if not lengths:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    return reduce(DataFrame.unionByName, [search_alike(rows.where(F.size("embedding") == n), is_query, k) for n in lengths])
