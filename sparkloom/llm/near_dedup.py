"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A document's shingles of five words weigh their count times a damped inverse document frequency. Samples that agree
with a probability equal to the weighted Jaccard similarity fall into bands; documents with an equal band are
candidates, and the weighted Jaccard similarity itself decides. Classes are connected components of verified links.

A weight is a shingle's count times one plus LARGEST times its inverse document frequency, as a share of the largest there
can be: ln((documents + 1) / frequency) / ln(RARE), at most 1. So shingles of fewer than one in RARE documents weigh most and all
alike, at any size of the corpus, and only frequent ones need a count of their own. Their number is bounded by RARE and the mean
number of shingles, so the table of their exact frequencies is small. It is found in two passes: a count-min sketch,
which never falls short, screens shingles, and those that pass are counted exactly. One is added because the bare
logarithm would be near nothing for shingles that a third of all documents share; near copies in so large a group
would be told apart by their own few edits alone.

Equal texts are one candidate. Within a band the most central text, the one whose bands are the fullest, is compared
with all others, which is linear in the band. A band whose texts that leaves in several components is then dealt in
blocks: the largest component's texts and the others'. Each pair of blocks, but for two of the largest component, is one
bounded group, in which texts of different components are compared and only links that join components come out. So
no link is lost to the shortcut, and no pairs are listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_arrow, release, written
from .components import components
from .words import WORD_BASES, Words, mixed, ranges, sums

SHINGLE, SIMILARITY = 5, 0.8
#: What text with words has.
WORD = r"[^\x20\x09-\x0D]"
#: At similarity 0.8 a pair shares a band with probability 1 - (1 - 0.8**4)**14 = 0.9994.
BANDS, ROWS = 14, 4
#: Shingles of fewer than one in so many documents have the largest inverse document frequency; and what that adds to one.
RARE, LARGEST = 256, 0.5
#: Rows and cells of the count-min sketch. A cell holds a few thousandths of all documents, whatever their number.
SKETCH_ROWS, SKETCH_CELLS = 3, 1 << 18
#: Texts of different components must agree on this share of samples before their shingles are compared. At similarity
#: 0.8 fewer agree with a probability of 4e-9, next to 6e-4 for no band in common: it saves time but loses nothing.
AGREEMENT = 0.45
#: Texts of a block, about: two blocks of a band are compared in one task.
BLOCK = 128

_rng = np.random.default_rng(77)
#: Draws of the sampling, r and ln c of gamma(2, 1) and uniform beta, looked up by hash of shingle and sample.
DRAWS_R, DRAWS_C, DRAWS_B = (x.astype(np.float32) for x in (_rng.gamma(2, 1, 1 << 16), np.log(_rng.gamma(2, 1, 1 << 16)), _rng.random(1 << 16)))
MULTIPLIERS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Shingles:
    """Distinct shingles of each text with their counts; a shorter text is one shingle, one without words has none."""

    def __init__(self, texts: list[str]):
        words = Words([x.lower().encode() for x in texts])
        size = np.minimum(SHINGLE, words.counts)
        each = np.where(words.counts > 0, words.counts - size + 1, 0)
        text = np.repeat(np.arange(len(texts)), each)
        at = np.repeat(words.bounds[:-1] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        hashes = ranges(sums(words.hashes, WORD_BASES[0]), at, at + size[text], WORD_BASES[0])
        order = np.lexsort((hashes, text))
        hashes, text = hashes[order], text[order]
        first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])])) if len(hashes) else np.zeros(0, np.int64)
        self.hashes, self.text = hashes[first], text[first]
        self.counts = np.diff(np.append(first, len(hashes)))
        self.bounds = np.searchsorted(self.text, np.arange(len(texts) + 1))


def places(hashes: np.ndarray) -> list[np.ndarray]:
    """Cells of the sketch in each of its rows."""
    return [((hashes >> np.uint64(20 * k)) % np.uint64(SKETCH_CELLS)).astype(np.int64) + k * SKETCH_CELLS for k in range(SKETCH_ROWS)]


@dataclass
class Weights:
    documents: int
    hashes: np.ndarray  # of the frequent shingles, sorted
    frequency: np.ndarray
    largest: float = LARGEST

    def of(self, shingles: Shingles) -> np.ndarray:
        idf = np.ones(len(shingles.hashes))
        if len(self.hashes) and len(idf):
            at = np.minimum(np.searchsorted(self.hashes, shingles.hashes), len(self.hashes) - 1)
            known = self.hashes[at] == shingles.hashes
            idf[known] = np.clip(np.log((self.documents + 1) / self.frequency[at[known]]) / np.log(RARE), 0, 1)
        return (shingles.counts * (1 + self.largest * idf)).astype(np.float32)


def sketched(documents: DataFrame) -> tuple[np.ndarray, int]:
    """The count-min sketch of all shingles, each once for a document, and the number of documents with words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(SKETCH_ROWS * SKETCH_CELLS, np.int64), 0
        for part in chunks(batches):
            own = Shingles(part.column("text").to_pylist())
            n += int((np.diff(own.bounds) > 0).sum())
            total += np.bincount(np.concatenate(places(own.hashes)), minlength=len(total))
        some = np.flatnonzero(total)
        for k in range(0, len(some), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(some[k : k + (1 << 16)].astype(np.int32)), pa.array(total[some[k : k + (1 << 16)]])], ["at", "n"])
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([n], pa.int64())], ["at", "n"])

    rows = map_arrow(documents.select("text"), count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # a row for each cell at most
    sketch = np.zeros(SKETCH_ROWS * SKETCH_CELLS + 1, np.int64)
    sketch[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    return sketch[:-1], int(sketch[-1])


def fit(documents: DataFrame) -> Weights:
    """Exact document frequencies of the shingles that one in RARE documents or more have."""
    sketch, n = sketched(documents)
    least = n / RARE
    shared = documents.sparkSession.sparkContext.broadcast(sketch >= least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            own = Shingles(part.column("text").to_pylist())
            found, times = np.unique(own.hashes[np.logical_and.reduce([shared.value[p] for p in places(own.hashes)])], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times)], ["shingle", "n"])

    counted = map_arrow(documents.select("text"), count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") >= least).toArrow()  # at most RARE times the mean number of a document's shingles
    hashes, frequency = rows.column("shingle").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(hashes)
    return Weights(n, hashes[order], frequency[order])


def samples(shingles: Shingles, weights: np.ndarray) -> np.ndarray:
    """Texts with shingles by samples: 32-bit hashes of the (shingle, step) that each sample picks."""
    has = np.flatnonzero(np.diff(shingles.bounds))
    starts = shingles.bounds[has]
    out = np.empty((len(has), len(MULTIPLIERS)), np.int32)
    if not len(has):
        return out
    log, index = np.log(weights), np.arange(len(weights), dtype=np.uint64)
    for i, m in enumerate(MULTIPLIERS):
        draw = ((shingles.hashes * m) >> np.uint64(48)).astype(np.int32)
        r, beta = DRAWS_R[draw], DRAWS_B[draw]
        step = np.floor(log / r + beta)
        a = DRAWS_C[draw] - r * (step - beta + 1)
        bits = a.view(np.uint32)
        key = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64) << np.uint64(32) | index
        best = (np.minimum.reduceat(key, starts) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        out[:, i] = (mixed(shingles.hashes[best] ^ step[best].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def keyed(documents: DataFrame) -> DataFrame:
    """``row``, a struct of all columns, doc_id, text made empty where null, and key, which is equal for equal texts."""
    text = F.coalesce("text", F.lit(""))
    return documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), "doc_id", text.alias("text"), F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")).alias("key"))


def signatures(texts: DataFrame, weights: Weights) -> DataFrame:
    """key and samples of each row of ``texts`` (key, text) with words."""
    shared = texts.sparkSession.sparkContext.broadcast(weights)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, most=1 << 20):
            own = Shingles(part.column("text").to_pylist())
            found = samples(own, shared.value.of(own))
            has = pa.array(np.flatnonzero(np.diff(own.bounds)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("key").take(has), lists], ["key", "samples"])

    return map_arrow(texts, work, "key struct<a: long, b: long>, samples array<int>")


def similarity(own: Shingles, weights: np.ndarray, i: int, j: int) -> float:
    a, b = slice(*own.bounds[i : i + 2]), slice(*own.bounds[j : j + 2])
    _, at, bt = np.intersect1d(own.hashes[a], own.hashes[b], assume_unique=True, return_indices=True)
    both = float(np.minimum(weights[a][at], weights[b][bt]).sum(dtype=np.float64))
    return both / (float(weights[a].sum(dtype=np.float64)) + float(weights[b].sum(dtype=np.float64)) - both)


def verified(pairs: DataFrame, texts: DataFrame, weights: Weights) -> DataFrame:
    """The pairs (u, v) whose texts have a weighted Jaccard similarity of SIMILARITY or more."""
    shared = pairs.sparkSession.sparkContext.broadcast(weights)
    left, right = (texts.select(F.col("key").alias(k), F.col("text").alias(f"text_{k}")) for k in "uv")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(chunks(batches, "text_u", 1 << 21), "text_v", 1 << 21):
            sides = [part.column(f"text_{k}").dictionary_encode() for k in "uv"]
            u, v = (s.indices.to_numpy() for s in sides)
            own = Shingles([x for s in sides for x in s.dictionary.to_pylist()])
            w = shared.value.of(own)
            passed = [similarity(own, w, i, len(sides[0].dictionary) + j) >= SIMILARITY for i, j in zip(u.tolist(), v.tolist())]
            yield part.select(["u", "v"]).filter(pa.array(passed, pa.bool_()))

    return map_arrow(pairs.join(left, "u").join(right, "v").select("u", "v", "text_u", "text_v"), work, "u struct<a: long, b: long>, v struct<a: long, b: long>")


def bags(texts: DataFrame, weights: Weights) -> DataFrame:
    """key, and the sorted shingle hashes of a text with their weights, as bytes."""
    shared = texts.sparkSession.sparkContext.broadcast(weights)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            own = Shingles(part.column("text").to_pylist())
            w, cuts = shared.value.of(own), list(zip(own.bounds, own.bounds[1:]))
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([own.hashes[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([w[a:b].tobytes() for a, b in cuts], pa.binary())], ["key", "hashes", "weights"])

    return map_arrow(texts.select("key", "text"), work, "key struct<a: long, b: long>, hashes binary, weights binary")


def joined_in_block(rows: pa.Table) -> list[tuple[int, int]]:
    """Places of verified links between different components of one pair of blocks, as few as join them."""
    band, block, component = rows.column("band")[0].as_py(), rows.column("block").to_numpy(), rows.column("component").to_pylist()
    names = {c: i for i, c in enumerate(dict.fromkeys((c["a"], c["b"]) for c in component))}
    root = np.array([names[c["a"], c["b"]] for c in component])
    samples_ = rows.column("samples").combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
    left = np.flatnonzero(block == block[0])
    right = left if rows.column("one")[0].as_py() else np.flatnonzero(block != block[0])
    hashes = [np.frombuffer(x, np.uint64) for x in rows.column("hashes").to_pylist()]
    weights = [np.frombuffer(x, np.float32) for x in rows.column("weights").to_pylist()]
    size = np.array([w.sum(dtype=np.float64) for w in weights])
    found = []
    for i in left:
        others = right[right > i] if right is left else right
        same = samples_[others] == samples_[i]
        earlier = same[:, : band * ROWS].reshape(len(others), band, ROWS).all(2).any(1)  # compared there
        js = others[(same.sum(1) >= AGREEMENT * BANDS * ROWS) & ~earlier & (root[others] != root[i])]
        if not len(js):
            continue
        flat, w = np.concatenate([hashes[j] for j in js]), np.concatenate([weights[j] for j in js])
        at = np.minimum(np.searchsorted(hashes[i], flat), len(hashes[i]) - 1)
        both = np.where(hashes[i][at] == flat, np.minimum(weights[i][at], w), 0).astype(np.float64)
        shared = np.add.reduceat(both, np.cumsum([0, *(len(hashes[j]) for j in js[:-1])]))
        for j in js[shared >= SIMILARITY * (size[i] + size[js] - shared)]:
            if root[j] != root[i]:
                found.append((int(i), int(j)))
                root[root == root[j]] = root[i]
    return found


def joined_across(open_: DataFrame) -> DataFrame:
    """Verified links (u, v) between components of each band of ``open_``: band, hash, key, component, samples, bag."""
    bands = ["band", "hash"]
    each = open_.groupBy(*bands, "component").agg(F.count("*").alias("n"))
    sizes = each.groupBy(*bands).agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n"))
    sizes = sizes.select(*bands, F.col("most.component").alias("largest"), F.ceil(F.col("most.n") / BLOCK).alias("theirs"), F.ceil((F.col("n") - F.col("most.n")) / BLOCK).alias("blocks"))
    # Blocks 0 to ``theirs`` - 1 hold the largest component, which isn't compared with itself; the rest hold the others.
    of_largest = F.col("component") == F.col("largest")
    of = F.xxhash64("key")
    dealt = open_.join(sizes, bands).withColumn("block", F.when(of_largest, F.pmod(of, F.col("theirs"))).otherwise(F.col("theirs") + F.pmod(of, F.col("blocks"))).cast("long"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.when(of_largest, F.col("theirs")).otherwise(F.lit(0)).cast("long"), (F.col("theirs") + F.col("blocks") - 1).cast("long"))))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    grouped = pairs.withColumn("g", F.xxhash64(*bands, low, high)).withColumn("one", F.col("block") == F.col("other"))
    columns = ["g", "band", "block", "one", "key", "component", "samples", "hashes", "weights"]
    ordered = grouped.select(*columns, low.alias("low"), high.alias("high"), "hash").repartition("g").sortWithinPartitions("g", "band", "hash", "low", "high", "block", "key")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def linked(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            links_ = joined_in_block(rows) if len(rows) > 1 else []
            if links_:
                keys = rows.column("key").combine_chunks()
                yield pa.RecordBatch.from_arrays([keys.take(pa.array([x[k] for x in links_])) for k in range(2)], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("g").to_numpy()
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for a, b in zip(cuts, cuts[1:]):
                part = pa.Table.from_batches([batch.slice(a, b - a)])
                if held and held[-1].column("g")[0].as_py() != g[a]:
                    yield from linked(pa.concat_tables(held))
                    held = []
                held.append(part)
        if held:
            yield from linked(pa.concat_tables(held))

    return map_arrow(ordered, work, "u struct<a: long, b: long>, v struct<a: long, b: long>")


def links(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components (node, component) of different texts, keys of ``keyed``, and the verified links between them."""
    texts = keyed(documents.select("doc_id", "text")).select("key", "text")
    weights = fit(texts)
    signed = written(signatures(texts, weights).groupBy("key").agg(F.first("samples").alias("samples")), "samples", bulky=True)
    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(F.slice("samples", i * ROWS + 1, ROWS)))).alias("band", "hash")
    posted = signed.select("key", band)
    # Joined as a table, so that the adaptive join can split a band with very many texts.
    full = written(posted.groupBy("band", "hash").agg(F.count("*").alias("n")).where("n > 1"), "full")
    shared = written(posted.join(full, ["band", "hash"]), "bands", bulky=True)

    central = shared.groupBy("key").agg(F.sum(F.log2("n")).alias("weight"))
    centres = written(shared.join(central, "key").groupBy("band", "hash").agg(F.max(F.struct("weight", "key")).alias("c")).select("band", "hash", F.col("c.key").alias("u")), "centres")
    star = shared.join(centres, ["band", "hash"]).where("u <> key").select("u", F.col("key").alias("v")).distinct()
    pairs = written(star, "pairs")
    some = written(texts.join(shared.select("key").distinct(), "key").dropDuplicates(["key"]), "texts", bulky=True)
    first = written(verified(pairs, some, weights), "verified", bulky=True)
    found = components(first)

    # Bands whose members are of several components: compare across components, block by block.
    label = shared.join(found.withColumnRenamed("node", "key"), "key", "left").select("band", "hash", "key", F.coalesce("component", "key").alias("component"))
    several = written(label.groupBy("band", "hash").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band", "hash"), "several")
    apart = written(label.join(several, ["band", "hash"]), "apart")
    bag = written(bags(some.join(apart.select("key").distinct(), "key", "left_semi"), weights).join(signed, "key"), "bags", bulky=True)
    second = written(joined_across(apart.join(bag, "key")), "verified", bulky=True)
    every = first.unionByName(second)
    if not second.isEmpty():
        found = components(every)
    release(signed, pairs, full, shared, centres, several, apart, bag, some)
    return found, every


def classes(documents: DataFrame) -> DataFrame:
    """doc_id and class_id, the smallest doc_id of the document's class, of each document.

    Documents with equal texts are one class, whatever their links; a text of fewer than five words is one shingle.
    Text without words, so null or empty text too, is never a copy: such a row is its own class. A class in which no
    document has an id has a null class_id. An empty table gives an empty result.
    """
    found, _ = links(documents)
    rows = keyed(documents.select("doc_id", "text")).select("doc_id", F.col("key").alias("node"), (~F.col("text").rlike(WORD)).alias("wordless"))
    with_words = rows.where("not wordless").select("doc_id", "node")
    lowest = with_words.groupBy("node").agg(F.min("doc_id").alias("low")).join(found, "node", "left").select("node", "low", F.coalesce("component", "node").alias("component"))
    lowest = written(lowest, "lowest")
    named = written(lowest.join(lowest.groupBy("component").agg(F.min("low").alias("class_id")), "component").select("node", "class_id"), "named", bulky=True)
    return with_words.join(named, "node").select("doc_id", "class_id").unionByName(rows.where("wordless").select("doc_id", F.col("doc_id").alias("class_id")))


def one_of_each(documents: DataFrame) -> DataFrame:
    """The first document of each class by doc_id, with all its columns, whatever their names; documents without words all
    stay, and cases as in ``classes``."""
    found, _ = links(documents)
    rows = keyed(documents)
    has_words = F.col("text").rlike(WORD)
    lowest = rows.where(has_words).groupBy(F.col("key").alias("node")).agg(F.min("doc_id").alias("low"))
    best = lowest.join(found, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min(F.struct(F.col("low").isNull().alias("no_id"), "low", "node")).alias("b"))
    chosen = written(best.select(F.col("b.node").alias("node"), F.col("b.low").alias("low")), "chosen", bulky=True)
    # The id is part of the join key, so the copies of one text don't meet in one task.
    same = (F.col("key") == F.col("node")) & F.col("doc_id").eqNullSafe(F.col("low"))
    kept = rows.where(has_words).join(chosen, same).dropDuplicates(["key", "doc_id"])
    return kept.select("row.*").unionByName(rows.where(~has_words).select("row.*"))
