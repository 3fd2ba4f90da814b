"""Texts as lossless audio, read back as PCM blocks with seekable sample offsets."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flac
from .common import chunks, map_arrow, release, with_text, written

#: Samples are padded with bytes 0 to a positive multiple of this.
UNIT = 64
#: Parts in which streams are stored and turned into blocks, one after the other.
PARTS = 4


def padded(text: str) -> bytes:
    data = text.encode()
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def store(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes of the text, and media, its padded bytes as a FLAC stream. Null text is empty: one unit of 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, most=1 << 20):
            texts = part.column("text").to_pylist()
            media = flac.encode([padded(x) for x in texts])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_arrow(with_text(documents), work, "doc_id long, n_bytes long, media binary")


def blocks(media: DataFrame) -> DataFrame:
    """One row for each frame: doc_id, block, first_sample, n_samples, byte_offset in the stream, and pcm.

    byte_offset is where the frame begins in the stream, as decoding finds it, whatever seek points the stream has.
    """
    return numbered_blocks(media.select("doc_id", F.lit(0).cast("long").alias("n_bytes"), "media")).select("doc_id", "block", "first_sample", "n_samples", "byte_offset", "pcm")


def numbered_blocks(media: DataFrame) -> DataFrame:
    """``blocks`` with a number for each stream, which holds once the rows are written, and what identifies its stored form."""
    schema = "stream long, doc_id long, n_bytes long, media_bytes long, media_sha256 string, n_blocks long, block long, first_sample long, n_samples long, byte_offset long, pcm binary"
    kinds = [pa.int64()] * 4 + [pa.string()] + [pa.int64()] * 5 + [pa.binary()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "media"):
            streams, rows = part.column("media").to_pylist(), []
            names = zip(*(part.column(c).to_pylist() for c in ("stream", "doc_id", "n_bytes")))
            for name, stream, (data, frames) in zip(names, streams, flac.decode_with_frames(streams)):
                stored = (*name, len(stream), hashlib.sha256(stream).hexdigest(), len(frames))
                rows += [(*stored, k, first, n, offset, data[first : first + n]) for k, (first, n, offset) in enumerate(frames)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], [x.split()[0] for x in schema.split(", ")])

    numbered = media.where("media is not null").select(F.monotonically_increasing_id().alias("stream"), "doc_id", "n_bytes", "media")
    return map_arrow(numbered, work, schema)


def stored_blocks(documents: DataFrame, parts: int = PARTS) -> DataFrame:
    """Written ``numbered_blocks`` of the stored FLAC streams of all documents, read back from the shared folder.

    Streams are as large as their texts are compressed, and only needed until their blocks are written; so the table is taken in
    ``parts`` by a hash of doc_id, each stored, read back, decoded and then released. Every row is in one part, whatever its
    doc_id; repeated rows and nulls too. An empty table has no blocks.
    """
    out = None
    for k in range(parts):
        own = documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == k)
        streams = written(store(own), "media", codec="uncompressed")
        found = written(numbered_blocks(streams).withColumn("stream", F.col("stream") * parts + k), "blocks", codec="zstd")
        release(streams)
        out = found if out is None else out.unionByName(found)
    return out


def feature(data: bytes) -> str:
    """Root mean square, zero crossings and peak of the samples, of integers only until the last step."""
    x = np.frombuffer(data, np.uint8).astype(np.int32) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"rms={(int((x.astype(np.int64) ** 2).sum()) / len(x)) ** 0.5:.4f};crossings={crossings};peak={int(np.abs(x).max())}"


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


#: Columns of ``numbered_blocks`` that a digest needs, and what it adds.
PIECES = "stream long, doc_id long, n_bytes long, media_bytes long, media_sha256 string, n_blocks long, first_sample long, pcm binary"
ADDED = "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"


def names_of(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def joined_blocks(blocks_: DataFrame, final: bool) -> DataFrame:
    """A row with null pcm and a digest for each stream whose blocks all follow one another in one task; other blocks come
    out as they are or, if this is ``final``, are an error. A task holds the blocks of one stream at a time."""
    kinds = [pa.int64()] * 4 + [pa.string()] + [pa.int64()] * 2 + [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def closed() -> list[tuple]:
            pcm = [x[-1] for x in held]
            if len(held) == held[0][5] and [x[6] for x in held] == [0, *accumulate(map(len, pcm))][:-1]:
                data = b"".join(pcm)
                return [(*held[0][:6], None, None, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), feature(data))]
            if final:
                raise ValueError("a stream doesn't have each of its blocks once")
            return [(*x, None, None, None, None) for x in held]

        def sent(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names_of(f"{PIECES}, {ADDED}"))

        for batch in chunks(batches, "pcm"):
            done = []
            for row in zip(*(batch.column(c).to_pylist() for c in names_of(PIECES))):
                if held and held[0][0] != row[0]:
                    done += closed()
                    held = []
                held.append(row)
            if done:
                yield sent(done)
        if held:
            yield sent(closed())

    return map_arrow(blocks_, work, f"{PIECES}, {ADDED}")


def block_digests(blocks_: DataFrame) -> DataFrame:
    """The rows of ``digests`` from written ``numbered_blocks``, whose payload is put together again by sample offsets. Repeated
    rows of a document are streams of their own and give a row each; no blocks give none.

    Only streams whose blocks the reader splits or doesn't keep in order are brought together by an exchange.
    A missing or doubled block is an error.
    """
    found = written(joined_blocks(blocks_.select(*names_of(PIECES)), False), "digests")
    apart = found.where("pcm is not null").select(*names_of(PIECES)).repartition("stream").sortWithinPartitions("stream", "first_sample")
    return found.where("pcm is null").unionByName(joined_blocks(apart, True)).select(*names_of(DIGESTS))


def digests(media: DataFrame) -> DataFrame:
    """Decode stored media, with all checksums verified, and return what identifies payload and stored form. A null stream is an
    error; an empty table has no rows."""
    schema = DIGESTS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "media"):
            streams = part.column("media").to_pylist()
            rows = [(len(d), hashlib.sha256(d).hexdigest(), zlib.crc32(d[-UNIT:]), len(s), hashlib.sha256(s).hexdigest(), feature(d)) for s, d in zip(streams, flac.decode(streams))]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *(pa.array(x, t) for x, t in zip(zip(*rows), kinds))], [x.split()[0] for x in schema.split(", ")])

    return map_arrow(media, work, schema)
