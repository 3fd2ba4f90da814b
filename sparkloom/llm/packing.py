"""Shortest-pack-first packing over the length histogram.

Documents become pieces of at most one sequence. Only the histogram of piece lengths (as many rows as a sequence
has tokens) reaches the driver, which places lengths longest first, each into the shortest pack that still takes
it, and counts equal packs as one pattern. A piece then finds its pattern by its rank among pieces of its length.
Ranks follow the files and rows of the input, so the order of a mix is the order in which pieces are placed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, map_arrow, with_text, written
from .encoding import encoder, vocabulary

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, part long, file long, run long, local_rank long"
#: What a run of rows is ordered by: the number of its file, the file, and its first row.
RUN = ["part", "file", "run"]
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def patterns(histogram: dict[int, int], most: int) -> list[tuple[int, tuple[int, ...]]]:
    """(how often, lengths) of each pattern. Cost and size depend on ``most``, not on the counts."""
    by_room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r in by_room if r >= length), default=None)
            if room is None:
                each = min(most // length, left)
                by_room.setdefault(most - each * length, []).append((left // each, (length,) * each))
                left %= each
                continue
            count, pack = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
            fits = min(room // length, max(1, left // count))  # a pack may take several at once
            used = min(count, left // fits)
            if used < count:
                by_room.setdefault(room, []).append((count - used, pack))
            by_room.setdefault(room - fits * length, []).append((used, pack + (length,) * fits))
            left -= used * fits
    return [x for packs in by_room.values() for x in packs]


def places(found: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows of length, first rank, first sequence and offset, ordered by length and rank."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for count, pack in found:
        offset = 0
        for length in pack:
            rows.append((length, taken.get(length, 0), sequence, offset))
            taken[length] = taken.get(length, 0) + count
            offset += length
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def with_places(documents: DataFrame) -> DataFrame:
    """doc_id and text with ``part``, ``file`` and ``row``: where a row lies in the files that were read. The reader deals
    files and their splits to tasks by length, so its partitions say nothing of their order; rows that aren't read from
    Parquet files have only their partitions."""
    try:
        read = documents.select("doc_id", "text", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("row"))
        read.schema  # resolves, or raises where rows have no file
    except AnalysisException:
        return with_text(documents, F.spark_partition_id().cast("long").alias("part"), F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row"))
    name = F.element_at(F.split("_path", "/"), -1)
    number = lambda pattern: F.coalesce(F.regexp_extract(name, pattern, 1).try_cast("long"), F.lit(0))
    part = number(r"^part-(\d+)") * (1 << 20) + number(r"-c(\d+)\.")  # a task's files are numbered too
    return with_text(read, part.cast("long").alias("part"), F.xxhash64("_path").alias("file"), "row")


def pieces_of(documents: DataFrame, tokenizer: str, end_id: int, most: int) -> DataFrame:
    """One row for each piece, with its rank among pieces of its length in its run of rows of one file; written once, so
    ranks stay."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
        """Batches of rows that follow one another in a file, and whether they don't follow the batch before."""
        before = None
        for part in chunks(batches):
            place = np.stack([part.column(c).to_numpy() for c in ("part", "file", "row")])
            new = np.append(True, (np.diff(place, axis=1) != [[0], [0], [1]]).any(0))
            new[0] = before is None or tuple(place[:, 0] - (0, 0, 1)) != before
            before = tuple(place[:, -1])
            cuts = sorted({0, *np.flatnonzero(new).tolist()})
            for a, b in zip(cuts, [*cuts[1:], part.num_rows]):
                yield bool(new[a]), part.slice(a, b - a)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ranks, own_run = encoder(tokenizer), np.zeros(most + 1, np.int64), (0, 0, 0)
        for new, part in runs(batches):
            if new:
                ranks, own_run = np.zeros(most + 1, np.int64), [part.column(c)[0].as_py() for c in ("part", "file", "row")]
            ids, ends = encode.encode(part.column("text").to_pylist())
            doc, start, length, crc, total = [], [], [], [], []
            for i, name in enumerate(part.column("doc_id").to_pylist()):
                own = np.append(ids[ends[i] : ends[i + 1]], np.uint32(end_id)).astype("<u4")
                for at in range(0, len(own), most):
                    piece = own[at : at + most]
                    doc.append(name)
                    start.append(at)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(own))
            sizes = np.array(length)
            order = np.argsort(sizes, kind="stable")
            kinds, first, counts = np.unique(sizes[order], return_index=True, return_counts=True)
            rank = np.empty(len(sizes), np.int64)
            rank[order] = np.arange(len(sizes)) - np.repeat(first, counts) + np.repeat(ranks[kinds], counts)
            ranks[kinds] += counts
            columns = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), *(pa.array(np.full(len(doc), x, np.int64)) for x in own_run), pa.array(rank)]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PIECES.split(", ")])

    return written(map_arrow(with_places(documents), work, PIECES), "pieces")


def pack(documents: DataFrame, tokenizer: str | None = None, end_id: int = 1, most: int = 2048) -> DataFrame:
    """Pack documents into sequences of at most ``most`` tokens; one row for each piece.

    A null or empty text is the end id alone. Equal rows are packed as often as they occur. A document longer than
    a sequence is cut into full pieces and a rest. An empty table gives an empty result; other columns are ignored.
    """
    pieces = pieces_of(documents, tokenizer or vocabulary("word_bpe_49k.json"), end_id, most)
    by_run = pieces.groupBy(*RUN, "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in by_run.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most one row for each length
    where = places(patterns(histogram, most))
    offsets = by_run.select(*RUN, "length", (F.sum("n").over(Window.partitionBy("length").orderBy(*RUN)) - F.col("n")).alias("before"))
    ranked = pieces.join(offsets, [*RUN, "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("local_rank")).alias("rank"))
    shared = pieces.sparkSession.sparkContext.broadcast(where)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        first, at = np.unique(rows[:, 0], return_index=True) if len(rows) else (None, None)
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column("length").to_numpy().astype(np.int64), batch.column("rank").to_numpy()
            found = np.empty(len(length), np.int64)
            bounds = np.append(at, len(rows))
            for k in np.unique(length):
                i, own = np.searchsorted(first, k), length == k
                lo, hi = bounds[i], bounds[i + 1]
                found[own] = lo + np.searchsorted(rows[lo:hi, 1], rank[own], side="right") - 1
            row = rows[found]
            columns = [batch.column("doc_id"), batch.column("start"), pa.array(length), batch.column("ids_crc32"), batch.column("doc_tokens"), pa.array(row[:, 2] + rank - row[:, 1]), pa.array(row[:, 3])]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PACKED.split(", ")])

    return map_arrow(ranked, place, PACKED)
