"""Token ids in files of independent zstandard frames with a trailing seek table.

A shard follows the zstandard seekable format: frames, then one skippable frame with the compressed size, raw
size and checksum (low 32 bits of XXH64 of the raw bytes) of each. A frame holds whole documents: their number,
ids and validity, token counts, then all token ids, little-endian. A reader that wants some documents looks
their frames up in the frame index and decompresses only those.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, map_arrow, new_path, ship, with_text, written
from .encoding import encoder, vocabulary

# Fixed values of the zstandard seekable format.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80

FRAME_BYTES = 1 << 20
INDEX = "path string, shard int, frame int, n_docs long, n_tokens long, place long, compressed long, raw long, first_id long, last_id long"


def file_of(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (pyarrow.fs.LocalFileSystem(), path)


def pack(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    known = np.array([x is not None for x in doc_ids], np.uint8)
    return struct.pack("<I", len(doc_ids)) + np.array([x or 0 for x in doc_ids], "<i8").tobytes() + known.tobytes() + np.array(counts, "<u4").tobytes() + ids.astype("<u4").tobytes()


def unpack(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    (n,) = struct.unpack_from("<I", raw)
    doc_ids, known = np.frombuffer(raw, "<i8", n, 4).tolist(), np.frombuffer(raw, np.uint8, n, 4 + 8 * n)
    return [x if k else None for x, k in zip(doc_ids, known)], np.frombuffer(raw, "<u4", n, 4 + 9 * n), np.frombuffer(raw, "<u4", offset=4 + 13 * n)


class ShardWriter:
    """Writes frames to one file; the caller keeps the index rows it yields."""

    def __init__(self, path: str, shard: int, level: int = 3):
        import zstandard

        system, name = file_of(path)
        system.create_dir(name.rpartition("/")[0], recursive=True)
        self.path, self.shard, self.out = path, shard, system.open_output_stream(name, compression=None)
        self.zstd, self.entries, self.place = zstandard.ZstdCompressor(level=level), [], 0

    def frame(self, doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> dict:
        import xxhash

        raw = pack(doc_ids, counts, ids)
        data = self.zstd.compress(raw)
        self.out.write(data)
        row = {"path": self.path, "shard": self.shard, "frame": len(self.entries), "n_docs": len(doc_ids), "n_tokens": int(sum(counts)), "place": self.place, "compressed": len(data), "raw": len(raw)}
        known = [x for x in doc_ids if x is not None]
        self.entries.append((len(data), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.place += len(data)
        return row | {"first_id": min(known, default=None), "last_id": max(known, default=None)}

    def close(self) -> None:
        table = b"".join(struct.pack("<III", *x) for x in self.entries) + struct.pack("<IBI", len(self.entries), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class ShardReader:
    """Reads the seek table, then only the frames asked for; a wrong checksum raises."""

    def __init__(self, path: str):
        system, name = file_of(path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError(f"{path} has no seek table with checksums")
        self.entries = np.frombuffer(self.file.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.places = np.concatenate([[0], np.cumsum(self.entries[:, 0])])

    def frame(self, k: int) -> bytes:
        import xxhash
        import zstandard

        size, raw, check = self.entries[k].tolist()
        data = zstandard.ZstdDecompressor().decompress(self.file.read_at(size, int(self.places[k])), max_output_size=raw)
        if len(data) != raw or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} doesn't match its checksum")
        return data

    def close(self) -> None:
        self.file.close()


def write_tokens(documents: DataFrame, directory: str, tokenizer: str, end_id: int = 0, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Encode documents and write them in ascending doc_id; returns the frame index, one row for each frame.

    Null text is empty and gives the end id alone; null doc_ids come first; rows of one doc_id are ordered by a
    hash of their text. Each shard is one range of doc_ids, its name includes the task attempt, and only files of
    attempts that succeeded get into the index, so lost executors leave nothing wrong behind. Other columns are
    ignored; an empty table gives an empty index.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, task = encoder(tokenizer), TaskContext.get()
        shard, out, rows = task.partitionId(), None, []
        doc_ids, counts, held, size = [], [], [], 0

        def flush() -> None:
            nonlocal doc_ids, counts, held, size, out
            if doc_ids:
                out = out or ShardWriter(f"{directory}/shard-{shard:06d}-{task.taskAttemptId()}.zst", shard)
                rows.append(out.frame(doc_ids, counts, np.concatenate(held)))
            doc_ids, counts, held, size = [], [], [], 0

        for part in chunks(batches):
            texts, names = part.column("text").to_pylist(), part.column("doc_id").to_pylist()
            ids, ends = encode.encode(texts)
            for i, name in enumerate(names):
                own = np.append(ids[ends[i] : ends[i + 1]], np.uint32(end_id))
                doc_ids.append(name)
                counts.append(len(own))
                held.append(own)
                size += 4 * len(own)
                if size >= frame_bytes:
                    flush()
        flush()
        if out:
            out.close()
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[t]) for n, t in (x.split() for x in INDEX.split(", "))]))

    ordered = with_text(documents).withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return written(map_arrow(ordered.select("doc_id", "text"), write, INDEX), "token-index", bulky=True)


def read_tokens(index: DataFrame, schema: str, work) -> DataFrame:
    """Apply ``work(doc_ids, counts, starts, ids)``, which returns a record batch, to each frame of ``index``.

    ``starts`` counts the ids of all documents before. A task opens a shard once and reads just the indexed frames.
    """
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    within = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("frame")) - F.col("n_tokens")
    frames = index.withColumn("within", within).join(before, "shard").select("path", "frame", "shard", (F.col("shard_start") + F.col("within")).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, open_path = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != open_path:
                    if reader:
                        reader.close()
                    reader, open_path = ShardReader(row["path"]), row["path"]
                doc_ids, counts, ids = unpack(reader.frame(row["frame"]))
                starts = row["start"] + np.concatenate([[0], np.cumsum(counts[:-1], dtype=np.int64)])
                yield work(doc_ids, counts, starts, ids)

    tasks = max(1, min(index.select("shard").distinct().count(), 100_000))
    return map_arrow(frames.repartition(tasks, "path").sortWithinPartitions("path", "frame"), read, schema)


def read_documents(paths: Iterable[dict], wanted: set[int]) -> dict[int, np.ndarray]:
    """Ids of a few documents: of the given index rows, only frames whose range holds a wanted id are decompressed."""
    out = {}
    for row in paths:
        if row["first_id"] is not None and any(row["first_id"] <= x <= row["last_id"] for x in wanted):
            reader = ShardReader(row["path"])
            doc_ids, counts, ids = unpack(reader.frame(row["frame"]))
            reader.close()
            ends = np.cumsum(counts, dtype=np.int64)
            out |= {x: ids[e - c : e] for x, c, e in zip(doc_ids, counts.astype(np.int64), ends) if x in wanted}
    return out


def digest(doc_ids, counts, starts, ids) -> pa.RecordBatch:
    ends = np.cumsum(counts, dtype=np.int64)
    crcs = [zlib.crc32(ids[e - c : e].tobytes()) for c, e in zip(counts.astype(np.int64), ends)]
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts.astype(np.int64)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digest(documents: DataFrame, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Write all documents, read the files back, and return doc_id, start, n_tokens and ids_crc32 from them."""
    spark = documents.sparkSession
    ship(spark)
    index = write_tokens(documents, new_path(spark, "tokens"), tokenizer or vocabulary("byte_bpe_50k.json"), end_id)
    return read_tokens(index, "doc_id long, start long, n_tokens long, ids_crc32 long", digest)
