"""Removal of repeated passages through a compacted De Bruijn graph.

Windows of ``size`` words are the edges of a De Bruijn graph. A window's anchor is its smallest k-mer of words, so
equal windows have equal anchors at equal places, and the edges that follow one another with one anchor form a
nonbranching path. Paths, not edges, go through the joins:

1. Anchors that occur once are unique, and so are all their edges; an exchange of counts finds the others.
2. Paths that meet at an anchor are compared as wholes. Where all are equal, every edge repeats.
3. Where paths branch, those that occur again as a whole repeat; each of the rest, and one of each repeated path, is
   taken apart into its edges at its source coordinates, and edges that two paths share repeat.

Repeated paths and edges of a document then join into spans at their source coordinates. Paths and edges are compared
by a cryptographic digest of the very words at their source coordinates, within one anchor, so other words pass for equal
only if 64 bits of BLAKE2 and 64 bits of the anchor agree by chance. Every window of every document is judged, and
nothing is removed before all are.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_arrow, release, written
from .words import WORD_BASES, Words, ranges, sliding_min, sums

#: Words of an anchor, and bits of a packed position; hashes are ordered by the bits above.
ANCHOR, PLACE_BITS = 8, 30
#: A path's first window and number of windows share one column.
RUN = 64


def digests(words: Words, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """What the words of each range are, joined by one space: 64 bits of BLAKE2."""
    own = words.words
    return np.frombuffer(b"".join([blake2b(b" ".join(own[i:j]), digest_size=8).digest() for i, j in zip(starts.tolist(), ends.tolist())]), np.int64)


def paths(words: Words, size: int) -> tuple[np.ndarray, ...]:
    """(text, first word, windows, anchor hash, digest) of all paths of the batch."""
    k = min(ANCHOR, size)
    first = words.windows(size)
    if not len(first):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    prefix = sums(words.hashes, WORD_BASES[0])
    at = np.arange(len(words.hashes) - k + 1)
    anchors = ranges(prefix, at, at + k, WORD_BASES[0])
    mask = np.uint64((1 << PLACE_BITS) - 1)
    place = (sliding_min((anchors & ~mask) | at.astype(np.uint64), size - k + 1)[first] & mask).astype(np.int64)
    text = np.searchsorted(words.bounds, first, side="right") - 1
    cut = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
    cut = np.unique(np.concatenate([cut, *(cut + j for j in range(RUN - 1, size, RUN - 1))])) if size - k + 1 >= RUN else cut
    cut = cut[cut < len(first)]
    n = np.diff(np.append(cut, len(first)))
    start = first[cut]
    return text[cut], start - words.bounds[text[cut]], n, anchors[place[cut]].view(np.int64), digests(words, start, start + n + size - 1)


def keyed(documents: DataFrame) -> DataFrame:
    """Equal keys (a, b) mean equal doc_id and text, so repeated rows share what is found out about them."""
    text = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", text.alias("text"), F.coalesce("doc_id", F.lit(-1)).alias("a"), F.xxhash64("doc_id", text).alias("b"))


def occurrences(documents: DataFrame, size: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            text, start, n, anchor, path = paths(Words([x.encode() for x in part.column("text").to_pylist()]), size)
            yield pa.RecordBatch.from_arrays([pa.array(part.column("a").to_numpy()[text]), pa.array(part.column("b").to_numpy()[text]), pa.array(start * RUN + n), pa.array(anchor), pa.array(path)], ["a", "b", "run", "anchor", "path"])

    return map_arrow(documents.select("a", "b", "text"), work, "a long, b long, run long, anchor long, path long")


def edges(documents: DataFrame, runs: DataFrame, size: int) -> DataFrame:
    """The windows of some paths, (a, b, run, anchor) of ``runs``: anchor, digest, and source coordinates."""
    by_text = runs.groupBy("a", "b").agg(F.collect_list(F.struct("run", "anchor")).alias("runs"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            words = Words([x.encode() for x in part.column("text").to_pylist()])
            lists = part.column("runs")
            flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
            text = np.repeat(np.arange(part.num_rows), sizes)
            run, anchor = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            n = run % RUN
            row = np.repeat(np.arange(len(run)), n)
            start = (run // RUN)[row] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            at = words.bounds[text[row]] + start
            edge = digests(words, at, at + size)
            yield pa.RecordBatch.from_arrays([pa.array(part.column("a").to_numpy()[text[row]]), pa.array(part.column("b").to_numpy()[text[row]]), pa.array(start * RUN + 1), pa.array(anchor[row]), pa.array(edge)], ["a", "b", "run", "anchor", "edge"])

    # One row of each key is enough: its windows stand for a path, not for how often it occurs.
    once = documents.select("a", "b", "text").join(by_text, ["a", "b"]).dropDuplicates(["a", "b"])
    return map_arrow(once.select("a", "b", "text", "runs"), work, "a long, b long, run long, anchor long, edge long")


def repeated_runs(documents: DataFrame, size: int) -> DataFrame:
    """(a, b, run) for every maximal path or single edge that occurs again, at its source coordinates."""
    spots = occurrences(documents, size)
    live = written(spots.groupBy("anchor").agg(F.count("*").alias("n"), F.min("path").alias("low"), F.max("path").alias("high")).where("n > 1").select("anchor", (F.col("low") != F.col("high")).alias("branches")), "anchors", bulky=True)
    met = written(spots.join(live, "anchor"), "paths", bulky=True)
    release(live)
    whole = met.where("not branches").select("a", "b", "run")
    branching = met.where("branches")
    distinct = written(branching.groupBy("anchor", "path").agg(F.count("*").alias("n"), F.min(F.struct("a", "b", "run")).alias("one")), "branches", bulky=True)
    again = branching.join(distinct.where("n > 1").select("anchor", "path"), ["anchor", "path"]).select("a", "b", "run")
    apart = written(edges(documents, distinct.select("one.*", "anchor"), size), "edges", bulky=True)
    shared = apart.groupBy("anchor", "edge").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "edge")
    return whole.unionByName(again).unionByName(apart.join(shared, ["anchor", "edge"]).select("a", "b", "run"))


def repeated_spans(documents: DataFrame, size: int = 35) -> DataFrame:
    """doc_id and, for each document with repeats, spans: an array of (start word, end word) that windows cover."""
    own = keyed(documents)
    by_text = repeated_runs(own, size).groupBy("a", "b").agg(F.collect_set("run").alias("runs"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = []
            for runs in batch.column("runs").to_pylist():
                found: list[list[int]] = []
                for run in sorted(runs):
                    start, end = run // RUN, run // RUN + run % RUN + size - 1
                    if found and start <= found[-1][1]:
                        found[-1][1] = max(found[-1][1], end)
                    else:
                        found.append([start, end])
                spans.append([{"start": s, "end": e} for s, e in found])
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(spans, kind)], ["a", "b", "spans"])

    return map_arrow(by_text, work, "a long, b long, spans array<struct<start: long, end: long>>")


def without_repeats(documents: DataFrame, size: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words that no repeated window covers, joined by spaces) and spans.

    Null text is empty. Documents of fewer than ``size`` words stay whole. Of rows that are equal as a whole, or equal
    texts, all copies repeat and lose all their windows. An empty table gives an empty result.
    """
    own = keyed(documents)
    joined = own.join(repeated_spans(documents, size), ["a", "b"], "left").select("doc_id", "text", "spans")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                words = text.encode().split()
                keep = bytearray(b"\1") * len(words)
                for span in spans or ():
                    keep[span["start"] : span["end"]] = bytes(span["end"] - span["start"])
                rest = [*compress(words, keep)] if spans else words
                n_words.append(len(words))
                n_removed.append(len(words) - len(rest))
                kept.append(b" ".join(rest).decode())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), part.column("spans")], ["doc_id", "n_words", "n_removed", "kept", "spans"])

    return map_arrow(joined, work, "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start: long, end: long>>")
