"""A stored inverted index: written once, read by term, with blocks that say how much they can add to a score.

    documents/  key, the index's metadata columns, length, digest of the text, segment
    postings/   term, segment, n, most (largest count), least (smallest length), hits (key, tf, length of n documents, and the
                places of the term if they were asked for)
    terms/      term, df, cf

Documents are dealt into segments of about ``BLOCK`` documents of like length (within a doubling; fewer where they are long), the
same for every term, so a block is a term's postings in one segment, and what a segment's documents can score at most is the
sum over the query's terms of what the block's largest count and smallest length would give. A segment is inverted by itself, in
one task's arrays. A file of postings holds some segments, sorted by term, and terms are range-partitioned, so a search reads of
each file the row groups of its terms; a term that all documents hold is split by segment.

A search for the best k scores the most promising segments first; their k-th score lets it skip every segment whose bound is
lower. Nothing that a skipped segment holds can be among the best, so results equal a full scan.

score = sum over query terms of ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average)).
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words
from ..operators.fulltext import K1, B
from .store import Files, shared_folder

BLOCK = 256
#: Segments that the first pass of a search scores.
PROBED = 8
#: Parquet row groups of postings stay small, so that a term's are read alone.
GROUP_BYTES = 4 << 20
#: Words that a segment of long documents holds on average, as one task's arrays hold a segment.
SEGMENT_WORDS = 1 << 20


def text_digest(text: Column) -> Column:
    return F.xxhash64(text)


class LexicalIndex:
    """An index in ``root``, of which ``number`` is the generation read."""

    def __init__(self, spark: SparkSession, root: str, number: int):
        self.spark, self.root, self.number = spark, root, number
        entry = json.loads(Files(spark, root).text(commit_name(root, number)))
        self.folder, self.key, self.total, self.average = entry["folder"], entry["key"], entry["documents"], entry["average"]

    def part(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    @property
    def documents(self) -> DataFrame:
        return self.part("documents")

    @property
    def postings(self) -> DataFrame:
        return self.part("postings")

    @property
    def terms(self) -> DataFrame:
        return self.part("terms")

    def weights(self, terms: Sequence[str]) -> dict[str, float]:
        """ln(1 + (N - df + 0.5) / (df + 0.5)) of the terms that occur; one row a term of the query."""
        rows = self.terms.where(F.col("term").isin(*set(terms))).select("term", "df").collect()
        return {r.term: math.log(1 + (self.total - r.df + 0.5) / (r.df + 0.5)) for r in rows}

    def share(self, tf: Column, length: Column) -> Column:
        """What a count and a length give for one term of weight 1; it grows with the count and falls with the length."""
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(self.average or 1.0)))

    def bounds(self, weights: dict[str, float]) -> DataFrame:
        """segment and bound, of the segments that hold a term; only block headers are read."""
        blocks = self.postings.where(F.col("term").isin(*weights)).select("term", "segment", "most", "least")
        return blocks.groupBy("segment").agg(F.sum(weight_of(weights) * self.share(F.col("most"), F.col("least"))).alias("bound"))

    def scored(self, weights: dict[str, float], segments: DataFrame | list[int] | None, where: Column | None, allowed: DataFrame | None) -> DataFrame:
        """key and score of the documents of the segments (all if None) that hold a term and meet the filters."""
        blocks = self.postings.where(F.col("term").isin(*weights)).select("term", "segment", "hits")
        if isinstance(segments, list):
            blocks = blocks.where(F.col("segment").isin(*segments))
        elif segments is not None:
            blocks = blocks.join(segments.select("segment"), "segment", "left_semi")
        hits = blocks.select("term", F.explode("hits").alias("h"))
        out = hits.groupBy(F.col("h.key").alias(self.key)).agg(F.sum(weight_of(weights) * self.share(F.col("h.tf"), F.col("h.length"))).alias("score"))
        if where is not None:
            out = out.join(self.documents.where(where).select(self.key), self.key, "left_semi")
        return out if allowed is None else out.join(allowed.select(self.key), self.key, "left_semi")

    def search(self, terms: Sequence[str], k: int | None = None, where: Column | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """key and score of documents with any of the terms, which meet ``where`` (on the metadata columns) and are in ``allowed``.

        With ``k`` every document that can be among the best k is there, others may be missing; rank and cut as you like.
        Repeated terms count once, terms that no document holds count nothing. Statistics are those of the whole index,
        whatever the filters.
        """
        weights = self.weights(terms)
        if not weights:
            return self.scored({"": 0.0}, [], None, None)
        if k is None:
            return self.scored(weights, None, where, allowed)
        return self.scored(weights, self.promising(weights, k, where, allowed), where, allowed)

    def phrases(self, phrases: Sequence[str], size: int = 3) -> DataFrame:
        """key, phrase and tf, how often each phrase of ``size`` characters and more stands in a document, of an index of its
        grams with places: the places of its grams, each less the gram's offset, must agree. Only segments that hold all grams of
        a phrase are read. Shorter phrases, which have no gram, are found nowhere."""
        asked = [(p, i, p[i : i + size]) for p in dict.fromkeys(phrases) for i in range(len(p) - size + 1)]
        grams = F.broadcast(self.spark.createDataFrame(asked or [("", 0, "")], "phrase string, offset int, term string"))
        wanted = grams.groupBy("phrase").agg(F.countDistinct("term").alias("wanted"), F.count("*").alias("offsets"))
        blocks = self.postings.where(F.col("term").isin(*{t for _, _, t in asked}))
        together = blocks.select("term", "segment").join(grams.select("phrase", "term").distinct(), "term").groupBy("phrase", "segment").agg(F.count("*").alias("n"))
        segments = together.join(F.broadcast(wanted), "phrase").where("n = wanted").select("phrase", "segment")
        hits = blocks.select("term", "segment", "hits").join(grams, "term").join(segments, ["phrase", "segment"], "left_semi").select("phrase", "offset", F.explode("hits").alias("h"))
        starts = hits.select("phrase", "h.key", F.explode("h.places").alias("place"), "offset").groupBy("phrase", "key", (F.col("place") - F.col("offset")).alias("start")).agg(F.count("*").alias("n"))
        whole = starts.join(F.broadcast(wanted), "phrase").where("n = offsets")
        return whole.groupBy(F.col("key").alias(self.key), "phrase").agg(F.count("*").alias("tf"))

    def phrase_search(self, phrases: Sequence[str]) -> DataFrame:
        """key and score of documents with any of the phrases, each weighted as a term of its own."""
        found = self.phrases(phrases).join(self.documents.select(self.key, "length"), self.key)
        df = found.groupBy("phrase").agg(F.count("*").alias("df"))
        weight = F.log(1 + (F.lit(float(self.total)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return found.join(F.broadcast(df), "phrase").groupBy(self.key).agg(F.sum(weight * self.share(F.col("tf"), F.col("length"))).alias("score"))

    def promising(self, weights: dict[str, float], k: int, where: Column | None = None, allowed: DataFrame | None = None) -> DataFrame | None:
        """Segments whose bound reaches the k-th best score of the most promising ones; None for all."""
        bounds = self.bounds(weights)
        first = [r.segment for r in bounds.orderBy(F.desc("bound"), "segment").limit(PROBED + 2 * k // BLOCK).collect()]
        best = self.scored(weights, first, where, allowed).select("score").orderBy(F.desc("score")).limit(k).collect()
        if len(best) < k:
            return None
        return bounds.where(F.col("bound") >= best[-1].score * (1 - 1e-9))

    def drift(self, docs: DataFrame, text: Column | str = "text") -> DataFrame:
        """One row: documents that the index lacks, that it alone has, and whose text is another; and all indexed."""
        now = docs.select(self.key, text_digest(column(text)).alias("now"))
        both = self.documents.select(self.key, "digest", F.lit(1).alias("indexed")).join(now.withColumn("there", F.lit(1)), self.key, "full_outer")
        return both.agg(
            F.count_if(F.col("indexed").isNull()).alias("missing"),
            F.count_if(F.col("there").isNull()).alias("unknown"),
            F.count_if(F.col("indexed").isNotNull() & F.col("there").isNotNull() & ~F.col("digest").eqNullSafe(F.col("now"))).alias("changed"),
            F.count("indexed").alias("indexed"),
        )

    def integrity(self) -> DataFrame:
        """One row: documents whose postings don't add up to their length, terms whose df isn't their postings', postings of no
        document. All are 0 in an index that is whole."""
        hits = self.postings.select("term", F.explode("hits").alias("h")).select("term", "h.*")
        sums = hits.groupBy(F.col("key").alias(self.key)).agg(F.sum("tf").alias("sum"))
        lengths = self.documents.select(self.key, F.coalesce("length", F.lit(0)).alias("length")).join(sums, self.key, "full_outer")
        counts = self.postings.groupBy("term").agg(F.sum("n").alias("n")).join(self.terms.select("term", "df"), "term", "full_outer")
        wrong_length = lengths.agg(F.count_if(F.col("length") != F.coalesce("sum", F.lit(0))).alias("wrong_length"), F.count_if(F.col("length").isNull()).alias("unknown"))
        return wrong_length.crossJoin(F.broadcast(counts.agg(F.count_if(~F.col("n").eqNullSafe(F.col("df"))).alias("wrong_df"))))


def weight_of(weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for term, weight in weights.items():
        out = F.when(F.col("term") == term, F.lit(weight)).otherwise(out)
    return out


def column(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def commit_name(root: str, number: int) -> str:
    return f"{root}/index/{number:012d}.json"


def last(spark: SparkSession, root: str) -> int:
    return max((int(x[:-5]) for x in Files(spark, root).names(f"{root}/index") if x[:-5].isdigit()), default=0)


def opened(spark: SparkSession, root: str, number: int | None = None) -> LexicalIndex | None:
    """The index of the last generation, or of ``number``; None where there is none."""
    number = last(spark, root) if number is None else number
    return LexicalIndex(spark, root, number) if number else None


def build(
    docs: DataFrame, root: str, key: str, text: Column | str = "text", metadata: Sequence[str] = (), expected: int | None = None, tokens: Callable[[Column], Column] = words, places: bool = False
) -> LexicalIndex:
    """Write a new generation of the index and publish it; fails if another was published since ``expected``. ``tokens`` makes the
    list of a text's terms, of which empty ones are not indexed; ``places`` keeps where in that list each stands.

    ``key`` is unique and not null. Null text has no terms and no length: it counts as a document but not in the average. Only
    texts move, once, to their segments; a segment's lists of terms, which are much longer, are made where it is inverted.
    """
    spark = docs.sparkSession
    files = Files(spark, root)
    start = last(spark, root) if expected is None else expected
    folder = f"{root}/{uuid.uuid4().hex}"
    try:
        found = docs.select(F.col(key), *metadata, text_digest(column(text)).alias("digest"), column(text).alias("_text"))
        found.withColumn("length", F.size(F.filter(tokens(F.col("_text")), lambda x: x != ""))).write.parquet(f"{folder}/texts")
        own = spark.read.parquet(f"{folder}/texts")
        doubling = F.floor(F.log2(F.coalesce("length", F.lit(0)) + 1)).cast("int")
        per_class = {r[0]: r[1:] for r in own.groupBy(doubling.alias("c")).agg(F.count("*"), F.count("length"), F.sum("length")).collect()}
        segment, at = F.lit(0), 0
        for c, (n, _, length) in sorted(per_class.items()):
            buckets = max(-(-n // BLOCK), -(-(length or 0) // SEGMENT_WORDS))
            segment = F.when(doubling == c, F.lit(at) + F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).otherwise(segment)
            at += buckets
        placed = own.withColumn("segment", segment)
        placed.drop("_text").write.parquet(f"{folder}/documents")
        together = placed.where("length > 0").select(F.col(key).alias("key"), "segment", "length", "_text").repartition("segment").sortWithinPartitions("segment")
        listed = together.select("key", "segment", "length", tokens(F.col("_text")).alias("terms"))
        hits = f"array<struct<key: {own.schema[key].dataType.simpleString()}, tf: int, length: int{', places: array<int>' if places else ''}>>"
        blocks = listed.groupBy("segment").applyInArrow(inverted(places), f"term string, segment int, n long, most int, least int, hits {hits}")
        blocks.sortWithinPartitions("term", "segment").write.option("parquet.block.size", GROUP_BYTES).parquet(f"{folder}/postings")
        stored = spark.read.parquet(f"{folder}/postings")
        cf = F.sum(F.aggregate("hits.tf", F.lit(0).cast("long"), lambda s, x: s + x))
        stored.groupBy("term").agg(F.sum("n").alias("df"), cf.alias("cf")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{folder}/terms")
        files.delete(f"{folder}/texts")
        total, known, length = (sum(x[i] or 0 for x in per_class.values()) for i in range(3))
        entry = {"folder": folder, "key": key, "documents": total, "average": length / known if known else 0.0}
        if not files.put_new(commit_name(root, start + 1), json.dumps(entry)):
            raise RuntimeError(f"generation {start + 1} of the index was published by another")
    except BaseException:
        files.delete(folder)
        raise
    return LexicalIndex(spark, root, start + 1)


def inverted(places: bool) -> Callable[[pa.Table], pa.Table]:
    """Makes the blocks of one segment from its documents' lists of terms, by sorting (term, document) as integers."""

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("key").combine_chunks()
        lists = rows["terms"].combine_chunks()
        terms = lists.flatten()
        of = lists.value_parent_indices().to_numpy()
        first = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        named = pc.not_equal(terms, "")
        place = np.flatnonzero(named.to_numpy(zero_copy_only=False))
        coded = terms.filter(named).dictionary_encode()
        code, of = coded.indices.to_numpy(), of[place]
        order = np.argsort(code.astype(np.uint16) if len(coded.dictionary) < 1 << 16 else code, kind="stable")  # documents and places stay in order
        code, of = code[order], of[order]
        starts = np.flatnonzero(np.diff(code, prepend=-1).astype(bool) | np.diff(of, prepend=-1).astype(bool))
        tf = np.diff(starts, append=len(code)).astype(np.int32)
        document, code = of[starts], code[starts]
        heads = np.flatnonzero(np.diff(code, prepend=-1))
        length = rows["length"].to_numpy()[document]
        parts = {"key": rows["key"].combine_chunks().take(pa.array(document)), "tf": pa.array(tf), "length": pa.array(length)}
        if places:
            parts["places"] = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)).astype(np.int32)), pa.array((place[order] - first[of]).astype(np.int32)))
        hits = pa.StructArray.from_arrays(list(parts.values()), names=list(parts))
        columns = {
            "term": coded.dictionary.take(pa.array(code[heads])),
            "segment": pa.array(np.full(len(heads), rows["segment"][0].as_py(), np.int32)),
            "n": pa.array(np.diff(heads, append=len(code)).astype(np.int64)),
            "most": pa.array(np.maximum.reduceat(tf, heads)),
            "least": pa.array(np.minimum.reduceat(length, heads)),
            "hits": pa.ListArray.from_arrays(pa.array(np.append(heads, len(code)).astype(np.int32)), hits),
        }
        return pa.table(columns)

    return work


def rebuilt(docs: DataFrame, root: str, key: str, text: Column | str = "text", metadata: Sequence[str] = (), most: float = 0.1, force: bool = False) -> tuple[LexicalIndex, bool]:
    """The index, built anew if there is none, if more than ``most`` of its documents are missing, unknown or changed, or if asked for;
    and whether it was."""
    index = opened(docs.sparkSession, root)
    if index is not None and not force:
        d = index.drift(docs, text).first()
        if d.missing + d.unknown + d.changed <= most * max(1, d.indexed):
            return index, False
    return build(docs, root, key, text, metadata, expected=index.number if index else 0), True


def of_table(spark: SparkSession, path: str, name: str, key: str, text: Column | str = "text", metadata: Sequence[str] = (), docs: DataFrame | None = None, **form) -> LexicalIndex:
    """The index of a stored table in the shared folder, built by the first that asks and again once the table's files have changed.

    Names, lengths and times of change of the files make the index's folder, so an index never meets another state of its table.
    """
    docs = spark.read.parquet(path) if docs is None else docs
    files = Files(spark, path)
    state = json.dumps([files.states(path), name, key, list(metadata)])
    root = f"{shared_folder(spark)}/lexical-{name}-{uuid.uuid5(uuid.NAMESPACE_URL, state).hex}"
    index = opened(spark, root)
    if index is None or not all(files.exists(f"{index.folder}/{part}/_SUCCESS") for part in ("documents", "postings", "terms")):  # a cleared folder
        try:
            index = build(docs, root, key, text, metadata, expected=index.number if index else 0, **form)
        except RuntimeError:  # another session was faster
            index = opened(spark, root)
            if index is None:
                raise
    return index
