"""All pairs of vectors within a radius, by products of matrices over pairs of tiles.

Equal vectors are one node first, so copies cost nothing. Nodes are sorted by group, nearest of some pivots and distance from
it, and cut into tiles; every pair of tiles is one unit of work, so no task holds more than two tiles however many vectors
there are. Two tiles, and two blocks of rows in them, are skipped where their distances from some pivot lie further apart than
the radius. Products of what is left say which pairs come near the radius, less what floating point may err; those alone
are compared exactly. Pivots are a bounded sample and change the work, not the result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from .graph import persisted

PIVOTS = 48
#: Rows of a tile; of a small table there are up to TILES smaller ones, of SMALL rows at least, so that all cores have work.
TILE, TILES, SMALL = 16384, 16, 1024
#: Rows and columns of one product.
ROWS, COLUMNS = 256, 2048


def nodes_of(rows: DataFrame, key: str, vector: str, within: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The different vectors of each group, named by the smallest key that has them, and each key's node. Null vectors have none."""
    some = persisted(rows.where(F.col(vector).isNotNull()).select(*within, key, F.col(vector).cast("array<double>").alias("x")))
    nodes = persisted(some.groupBy(*within, "x").agg(F.min(key).alias("node")))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*within, "x")]
    other = nodes.select(*(F.col(c).alias(f"_{c}") for c in (*within, "x")), "node")
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return nodes, some.join(other, condition).select(*within, key, "node")


def candidates(nodes: DataFrame, radius: float, within: Sequence[str] = (), pivots: int = PIVOTS, measure: str = "distance") -> DataFrame:
    """u, v and measure (``distance`` or ``dot``) of the pairs of nodes that come near the radius, each once; of groups ``within`` only
    pairs in one group. Vectors of different lengths, or with components that are null or not finite, are near nothing."""
    reach = radius * (1 + 1e-9) + 1e-12
    sample = nodes.orderBy(F.xxhash64("x"), "node").limit(pivots).select("x").collect()
    length = len(sample[0].x) if sample else 0
    centers = np.array([r.x for r in sample if len(r.x) == length and None not in r.x], float).reshape(-1, length)
    finite = F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    group = F.xxhash64(F.size("x"), *(c for w in within for c in (F.col(w).isNull(), F.col(w))))
    rows = nodes.where(finite).select("node", group.alias("group"), F.col("x").cast("array<double>").alias("x"))
    kind = nodes.schema["node"].dataType.simpleString()
    n = nodes.count()
    cuts = max(-(-n // TILE), min(TILES, -(-n // SMALL)), 1)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, near = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            for at, x in matrices(batch):
                if len(far := distances(x, centers).T):
                    home[at], near[at] = far.argmin(0), far.min(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(near)], [*batch.schema.names, "home", "near"])

    ordered = rows.mapInArrow(placed, f"node {kind}, group long, x array<double>, home int, near double").repartitionByRange(cuts, "group", "home", "near", "node")
    tiled = persisted(ordered.select(F.spark_partition_id().alias("tile"), "node", "group", "x"))

    spans = pa.list_(pa.float64())

    def outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tile, groups = batch.column("tile").to_numpy(), batch.column("group").to_numpy()
            for at, x in matrices(batch):
                far = distances(x, centers)
                for t in np.unique(tile[at]):
                    own = tile[at] == t
                    g, f = groups[at][own], far[own]
                    yield pa.RecordBatch.from_pydict({"tile": pa.array([t], pa.int32()), "first": [g.min()], "last": [g.max()], "low": pa.array([f.min(0)], spans), "high": pa.array([f.max(0)], spans)})

    # What parts of a tile reach makes at least what the tile reaches, so parts of tiles are what is compared here.
    parts = persisted(tiled.mapInArrow(outlines, "tile int, first long, last long, low array<double>, high array<double>"))
    other = parts.select(*(F.col(c).alias(f"{c}_b") for c in parts.columns))
    apart = lambda a, b: F.exists(F.zip_with(a, b, lambda x, y: x - y > margin(reach)), lambda far: F.coalesce(far, F.lit(False)))
    meet = (F.col("tile") <= F.col("tile_b")) & (F.col("first") <= F.col("last_b")) & (F.col("first_b") <= F.col("last"))
    met = parts.join(other, meet).where(~apart("low", "high_b") & ~apart("low_b", "high")).select("tile", "tile_b").distinct()
    pairs = persisted(met.select(F.xxhash64("tile", "tile_b").alias("pair"), "tile", "tile_b"))
    sides = pairs.select("pair", F.explode(F.array_distinct(F.array(F.struct("tile", F.lit(0).alias("side")), F.struct(F.col("tile_b").alias("tile"), (F.col("tile") != F.col("tile_b")).cast("int").alias("side"))))).alias("s")).select("pair", "s.*")
    work = tiled.join(F.broadcast(sides), "tile").select("pair", "side", "node", "group", "x")
    work = work.repartition(max(pairs.count(), 1), "pair").sortWithinPartitions("pair", "side")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for both in runs(batches, "pair"):
            side = both.column("side").to_numpy()
            left = both.filter(pa.array(side == 0))
            right = left if side[-1] == 0 else both.filter(pa.array(side == 1))
            for i, j, value in near_pairs(left, right, reach, centers, measure):
                ends = [t.column("node").take(pa.array(k)).combine_chunks() for t, k in ((left, i), (right, j))]
                yield pa.RecordBatch.from_arrays([*ends, pa.array(value)], ["u", "v", measure])

    return work.mapInArrow(compared, f"u {kind}, v {kind}, {measure} double")


def margin(reach: float) -> float:
    """Distances from pivots are floating point too: what they may lie apart beyond the radius."""
    return reach + 1e-6 * (1 + reach)


def matrices(rows: pa.RecordBatch | pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the rows of each length of vector."""
    x = rows.column("x")
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    sizes = x.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        own = x if len(at) == len(sizes) else x.take(pa.array(at))
        yield at, own.flatten().to_numpy(zero_copy_only=False).reshape(len(at), size)


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """From each pivot; none where vectors are of another length than pivots."""
    if not len(centers) or centers.shape[1] != x.shape[1]:
        return np.zeros((len(x), 0))
    return np.sqrt(np.stack([((x - c) ** 2).sum(1) for c in centers], 1))


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, which follow one another."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = batch.column(key).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for low, high in zip(edges, edges[1:]):
            if low == high:
                continue
            if kept and keys[low] != last:
                yield pa.Table.from_batches(kept).combine_chunks()
                kept = []
            kept.append(batch.slice(low, high - low))
            last = keys[low]
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def near_pairs(left: pa.Table, right: pa.Table, reach: float, centers: np.ndarray, measure: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in both tables, and measure, of pairs that are near; of a table with itself each pair once."""
    groups = left.column("group").to_numpy(), right.column("group").to_numpy()
    for at, x in matrices(left):
        for to, y in [(at, x)] if right is left else matrices(right):
            if x.shape[1] == y.shape[1]:
                for i, j, value in of_blocks(Side(x, groups[0][at], centers), None if right is left else Side(y, groups[1][to], centers), reach, measure):
                    yield at[i], to[j], value


class Side:
    """Rows in order of group, nearest pivot and distance from it, with what blocks of them span."""

    def __init__(self, x: np.ndarray, group: np.ndarray, centers: np.ndarray):
        far = distances(x, centers)
        self.place = np.lexsort((far.min(1), far.argmin(1), group)) if far.shape[1] else np.argsort(group, kind="stable")
        self.x, self.group, far = np.ascontiguousarray(x[self.place]), group[self.place], far[self.place]
        self.square = (self.x**2).sum(1)
        starts = np.arange(0, len(x), ROWS)
        self.first, self.last = self.group[starts], self.group[np.minimum(starts + ROWS, len(x)) - 1]
        self.low, self.high = np.minimum.reduceat(far, starts, 0), np.maximum.reduceat(far, starts, 0)


def of_blocks(a: Side, b: Side | None, reach: float, measure: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    same, b = b is None, b or a
    # (x, -xx / 2, 1) (y, 1, -yy / 2) is minus half the squared distance.
    mine = np.column_stack([a.x, -a.square / 2, np.ones(len(a.x))])
    theirs = np.column_stack([b.x, np.ones(len(b.x)), -b.square / 2])
    least = -(reach**2) / 2 - 4e-16 * (a.x.shape[1] + 8) * (a.square.max() + b.square.max())
    wide = COLUMNS // ROWS
    for k, start in enumerate(range(0, len(a.x), ROWS)):
        keep = (b.first <= a.last[k]) & (a.first[k] <= b.last)
        keep &= ~((a.low[k] - b.high > margin(reach)).any(1) | (b.low - a.high[k] > margin(reach)).any(1))
        if same:
            keep[:k] = False
        for c in range(k // wide * wide if same else 0, len(keep), wide):
            if not (kept := np.flatnonzero(keep[c : c + wide])).size:
                continue
            low, high = (c + kept[0]) * ROWS, (c + kept[-1] + 1) * ROWS
            product = mine[start : start + ROWS] @ theirs[low:high].T
            i, j = np.divmod(np.flatnonzero(~(product < least)), product.shape[1])
            i, j = i + start, j + low
            ok = a.group[i] == b.group[j]
            if same:
                ok &= i < j
            i, j = i[ok], j[ok]
            total = np.zeros(len(i))
            x, y = a.x[i], b.x[j]
            for d in range(x.shape[1]):  # in the order of a plain sum
                total += x[:, d] * y[:, d] if measure == "dot" else (x[:, d] - y[:, d]) ** 2
            value = total if measure == "dot" else np.sqrt(total)
            if measure == "distance":
                i, j, value = i[value <= reach], j[value <= reach], value[value <= reach]
            if len(i):
                yield a.place[i], b.place[j], value


def close_pairs(nodes: DataFrame, radius: float, within: Sequence[str] = (), pivots: int = PIVOTS) -> DataFrame:
    """u, v and distance of all pairs of nodes at most ``radius`` apart, each once, in no order of u and v."""
    return candidates(nodes, radius, within, pivots).where(F.col("distance") <= radius)


def unit(vector: Column) -> Column:
    """The vector at length 1; null if it is zero, so that it takes part in nothing. Vector and norm are bound, or they would be
    computed again for every component."""
    scaled = lambda x: F.transform(F.array(F.sqrt(N.dot(x, x))), lambda norm: F.when(norm > 0, F.transform(x, lambda v: v / norm)))
    return F.get(F.flatten(F.transform(F.array(vector.cast("array<double>")), scaled)), F.lit(0))


def cosine_pairs(nodes: DataFrame, least: float, within: Sequence[str] = (), pivots: int = PIVOTS) -> DataFrame:
    """u, v and cosine of all pairs of unit vectors whose cosine reaches ``least`` (above -1)."""
    pairs = candidates(nodes, (2 - 2 * least) ** 0.5 + 1e-9, within, pivots, "dot").withColumnRenamed("dot", "cosine")
    return pairs.where(F.col("cosine") >= least)
