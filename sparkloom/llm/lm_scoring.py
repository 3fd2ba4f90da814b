"""Cross-entropy difference of documents under two n-gram models.

A target model learns from the documents that labels call good, a background model from all documents. Both are
interpolated bigram models over one vocabulary, all words of the corpus, with counts of the background scaled to the
target's number of tokens, so that neither is better for having seen more. The score is the mean over tokens of target loss
minus background loss: the lower, the more a document is like the target.

A document is left out of the counts it is scored against: otherwise every document would find its own rare bigrams
in the model, and a target document would look like the target for having been read before.

Models are as large as the corpus, so no task holds one. Documents are dealt to chunks. Each chunk asks for the counts of
its different n-grams, by hash, in packed lists dealt to buckets of the hash range; a bucket adds up what its chunks ask
for, which is the count of each n-gram, and answers each list in its order. A chunk then meets the answers to its lists and
scores its documents. Every n-gram of every document is counted, and an n-gram that all documents share is asked for once
by each chunk. N-grams are identified by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, freed, map_arrow, ship, written
from .words import WORD_BASES, Words, mixed

#: Weight of the unigram estimate in a bigram's, in tokens.
PRIOR = 20.0
#: Bytes of text of a chunk, about, and n-grams of a bucket, about.
CHUNK, BUCKET = 1 << 24, 1 << 20
#: Tokens of a partition in which documents are scored, about.
TOKENS = 1 << 21
#: The hash of what comes before a document's first word; it counts as a word.
START = np.uint64(0x632BE59BD9B4E019)


def lowered(part: pa.RecordBatch) -> Words:
    return Words([x.lower().encode() for x in part.column("text").to_pylist()])


def ngrams(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token the hashes of its word, of what comes before it (START before a document's first), and of the two.
    Words have hashes in the lower half, pairs in the upper."""
    word = words.hashes >> np.uint64(1)
    before = np.concatenate([[START], word[:-1]]) if len(word) else word
    before[words.bounds[:-1][words.counts > 0]] = START
    return word, before, mixed(before * np.uint64(WORD_BASES[0]) + word * np.uint64(WORD_BASES[1])) | np.uint64(1 << 63)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers, most of them small or alike: the planes of their bytes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def dealt(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), whether any label calls the document good, and chunk; written once, so chunks stay.

    Unlabelled documents and null ids aren't target. Labels grow with the documents, so they are never broadcast, not
    even where they would be small enough.
    """
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("good", F.lit(True))
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(good.hint("merge"), "doc_id", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = 0, 0
        for part in chunks(batches):
            yield part.append_column("chunk", pa.array(np.full(part.num_rows, int(part.column("task")[0].as_py()) << 32 | chunk)))
            held += part.column("text").nbytes
            if held > CHUNK:
                chunk, held = chunk + 1, 0

    tasks = rows.select("doc_id", "text", F.coalesce("good", F.lit(False)).alias("target"), F.spark_partition_id().cast("long").alias("task"))
    return written(map_arrow(tasks, work, "doc_id long, text string, target boolean, task long, chunk long").drop("task"), "chunks", bulky=True)


def totals(rows: DataFrame) -> tuple[int, int]:
    """Tokens of the target and of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(2, np.int64)
        for part in chunks(batches):
            counts = np.array([len(x.split()) for x in part.column("text").to_pylist()], np.int64)
            n += [counts[part.column("target").to_numpy(zero_copy_only=False)].sum(), counts.sum()]
        yield pa.RecordBatch.from_arrays([pa.array(n[:1]), pa.array(n[1:])], ["target", "background"])

    row = map_arrow(rows.select("text", "target"), count, "target long, background long").agg(F.sum("target"), F.sum("background")).first()
    return row[0] or 0, row[1] or 0


def of_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Batches of rows of one chunk that follow one another. A chunk may come in several parts."""
    own: int | None = None
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        chunk = batch.column("chunk").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
        for a, b in zip(cuts, cuts[1:]):
            if held and own != chunk[a]:
                yield own, held
                held = []
            own = int(chunk[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield own, held


def counted(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of some documents, sorted, and how often (target, background) they occur."""
    found = []
    for part in chunks(iter(parts)):
        words = lowered(part)
        good = part.column("target").to_numpy(zero_copy_only=False)[words.text_of()]
        word, before, pair = ngrams(words)
        starts = before == START
        all_, good_ = np.concatenate([word, pair, before[starts]]), np.concatenate([good, good, good[starts]])
        grams, at = np.unique(all_, return_inverse=True)
        found.append((grams, np.bincount(at, good_, len(grams)), np.bincount(at, minlength=len(grams))))
    grams, at = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
    return grams, np.stack([np.bincount(at, np.concatenate([x[k] for x in found]), len(grams)) for k in (1, 2)]).astype(np.int64)

def bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of hashes in order; those of words are the first half."""
    return ((grams >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def asked(rows: DataFrame, buckets: int) -> DataFrame:
    """A row for each chunk (or part of one) and bucket: its n-grams in order, and its own counts of them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, parts in of_chunks(batches):
            grams, counts = counted(parts)
            bounds = np.searchsorted(bucket_of(grams, buckets), np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(bounds))
            for k in range(0, len(some), 256):
                cuts = [slice(bounds[b], bounds[b + 1]) for b in some[k : k + 256]]
                lists = ([packed(x) for x in own] for own in ([np.diff(grams[c], prepend=np.uint64(0)) for c in cuts], [counts[0, c] for c in cuts], [counts[1, c] for c in cuts]))
                yield pa.RecordBatch.from_arrays([pa.array(some[k : k + 256]), pa.array([chunk] * len(cuts), pa.int64()), *(pa.array(x, pa.binary()) for x in lists)], ["bucket", "chunk", "grams", "target", "background"])

    return map_arrow(rows.select("chunk", "text", "target"), work, "bucket long, chunk long, grams binary, target binary, background binary")


def answered(lists: DataFrame) -> DataFrame:
    """For each chunk and bucket the counts over all chunks of the n-grams that the chunk has there, in order; and, in one
    row of a bucket, how many different n-grams the bucket has. A bucket's size doesn't depend on that of the corpus."""

    def work(rows: pa.Table) -> pa.Table:
        chunk = rows.column("chunk").to_numpy()
        grams = [np.cumsum(unpacked(x), dtype=np.uint64) for x in rows.column("grams").to_pylist()]
        known, at = np.unique(np.concatenate(grams), return_inverse=True)
        total = [np.bincount(at, np.concatenate([unpacked(x) for x in rows.column(c).to_pylist()]), len(known)).astype(np.uint64) for c in ("target", "background")]
        at = np.split(at, np.cumsum([len(x) for x in grams])[:-1])
        names = np.unique(chunk)
        own = [np.unique(np.concatenate([at[i] for i in np.flatnonzero(chunk == c)])) for c in names]  # parts of a chunk as one
        columns = [pa.array(names), pa.array(np.full(len(names), rows.column("bucket")[0].as_py())), pa.array([len(known)] + [0] * (len(names) - 1), pa.int64()), *(pa.array([packed(t[x]) for x in own], pa.binary()) for t in total)]
        return pa.Table.from_arrays(columns, ["chunk", "bucket", "different", "target", "background"])

    ship(lists.sparkSession)
    return lists.groupBy("bucket").applyInArrow(work, "chunk long, bucket long, different long, target binary, background binary")


def times(text: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """How often each place's n-gram occurs in its own text."""
    _, at, n = np.unique(text * (int(gram.max()) + 1) + gram if len(gram) else gram, return_inverse=True, return_counts=True)
    return n[at]


def losses(words: Words, target: np.ndarray, grams: np.ndarray, counts: np.ndarray, total: tuple[int, int], size: int) -> np.ndarray:
    """Target and background loss of each token in nats; each text is left out of the counts it is scored against."""
    word, before, pair = ngrams(words)
    first = before == START
    some, at = np.unique(np.concatenate([word, pair]), return_inverse=True)
    word, pair = np.split(np.searchsorted(grams, some)[at], 2)  # searched in order, which is quicker
    before = np.where(first, np.searchsorted(grams, START), np.concatenate([word[:1], word[:-1]]))
    text = words.text_of()
    own_word, own_pair = times(text, word), times(text, pair)
    own_before = np.where(first, 1, np.concatenate([[1], own_word[:-1]]))
    n = np.stack([total[0] - words.counts * target, total[1] - words.counts])[:, text].astype(np.float64)
    mine = np.stack([target[text], np.ones(len(text))])
    out = []
    for k in range(2):
        scale = n[0] / np.maximum(n[k], 1)
        single = ((counts[k, word] - mine[k] * own_word) * scale + 1) / (n[0] + size)
        seen = (counts[k, before] - mine[k] * own_before) * scale
        both = (counts[k, pair] - mine[k] * own_pair) * scale
        out.append(-np.log((both + PRIOR * single) / (seen + PRIOR)))
    return np.stack(out)


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background and score of each document.

    A document without words, so null or empty text too, has 0 tokens and null losses. Without any good document both models
    are uniform. Repeated rows count as often as they occur, but for the row itself, and score alike; other columns are
    ignored; an empty table gives an empty result. A very long text is a chunk of its own.
    """
    rows = dealt(documents, labels)
    total = totals(rows)
    half = max(1, -(-total[1] // BUCKET))  # buckets of words, and as many of pairs
    answers = written(answered(asked(rows, 2 * half)), "answers", bulky=True)
    size = answers.where(F.col("bucket") < half).agg(F.sum("different")).first()[0] or 0
    schema = "doc_id long, n_tokens long, loss_target double, loss_background double, score double"

    def work(texts: pa.Table, own: pa.Table) -> pa.Table:
        parts = texts.to_batches()
        grams, _ = counted(parts)
        own = own.sort_by("bucket")
        counts = np.stack([np.concatenate([unpacked(x) for x in own.column(c).to_pylist()] or [np.zeros(0, np.uint64)]).astype(np.float64) for c in ("target", "background")])
        if counts.shape[1] != len(grams):
            raise RuntimeError(f"{counts.shape[1]} answers for {len(grams)} n-grams")
        out = []
        for part in chunks(iter(parts)):
            words = lowered(part)
            some = words.counts > 0
            mean = np.full((2, part.num_rows), np.nan)
            if some.any():
                each = losses(words, part.column("target").to_numpy(zero_copy_only=False).astype(np.int64), grams, counts, total, size)
                mean[:, some] = np.add.reduceat(each, words.bounds[:-1][some], axis=1) / words.counts[some]
            columns = [pa.array(x, mask=~some) for x in (mean[0], mean[1], mean[0] - mean[1])]
            out.append(pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words.counts), *columns], [x.split()[0] for x in schema.split(", ")]))
        return pa.Table.from_batches(out)

    freed(rows.sparkSession)
    # As many partitions as the texts ask for, whatever the session says.
    texts, own = (df.repartition(max(1, -(-total[1] // TOKENS)), "chunk") for df in (rows, answers.select("chunk", "bucket", "target", "background")))
    return texts.groupBy("chunk").cogroup(own.groupBy("chunk")).applyInArrow(work, schema)
