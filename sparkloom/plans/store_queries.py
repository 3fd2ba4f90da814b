"""Files of an index replaced, removed and published, and what is live afterwards. A document is a chunk, its source the file."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import generations, index_store
from ..sources.store import shared_folder
from .registry import Tables, query


def new_root(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def chunks(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("file"), F.col("n_chars").alias("size"))


TOXIC = "(SELECT source FROM documents JOIN labels USING (doc_id) GROUP BY source HAVING sum(toxic) >= 3)"
LARGEST = "(SELECT source FROM documents GROUP BY source ORDER BY sum(n_chars) DESC, source LIMIT 1)"


def toxic_files(t: Tables) -> DataFrame:
    found = t.documents.select("doc_id", "source").join(t.labels.select("doc_id", "toxic"), "doc_id").groupBy("source").agg(F.sum("toxic").alias("n"))
    return found.where("n >= 3").select(F.col("source").alias("file"))


def replaced_store(t: Tables) -> str:
    """A first index, then a commit that replaces files with several toxic chunks by what isn't toxic in them, another that removes
    the largest file, and a write that fails on its second file and must leave nothing."""
    root = new_root(t, "files")
    generations.write(chunks(t), root, ["file"], "chunk_id", base=True)
    clean = t.documents.join(t.labels.where("toxic = 1").select("doc_id"), "doc_id", "left_anti")
    new = clean.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("file"), (F.length("text") + 1).cast("long").alias("size")).join(toxic_files(t), "file", "left_semi")
    generations.write(new.select("chunk_id", "file", "size"), root, ["file"], "chunk_id")
    largest = t.documents.groupBy("source").agg(F.sum("n_chars").alias("n")).orderBy(F.desc("n"), "source").limit(1).select(F.col("source").alias("file"))
    generations.write(chunks(t).limit(0), root, ["file"], "chunk_id", removed=largest)
    twice = chunks(t).where("file IN ('src1', 'src2')").withColumn("size", F.lit(0).cast("long"))
    try:
        generations.write(twice.unionByName(twice.where("file = 'src2'")), root, ["file"], "chunk_id")
    except ValueError:
        pass
    return root


@query(f"""
SELECT doc_id AS chunk_id, source AS file, CASE WHEN source IN {TOXIC} THEN length(text) + 1 ELSE n_chars END::BIGINT AS size FROM documents LEFT JOIN labels USING (doc_id)
WHERE source NOT IN {LARGEST} AND NOT (source IN {TOXIC} AND coalesce(toxic, 0) = 1)""")
def sink_atomic_file_replace(t: Tables) -> DataFrame:
    """Chunks that a reader sees after replacements, a removal and a failure."""
    return generations.read(t.spark, replaced_store(t)).select("chunk_id", "file", "size")


@query(f"""
SELECT source AS file, count(*) AS chunks, CASE WHEN source IN {TOXIC} THEN 2 ELSE 1 END::BIGINT AS generation,
 CASE WHEN count(*) = any_value(there) THEN 'ready' ELSE 'partial' END AS status
FROM (SELECT *, count(*) OVER (PARTITION BY source) AS there FROM documents) LEFT JOIN labels USING (doc_id) WHERE source NOT IN {LARGEST} AND NOT (source IN {TOXIC} AND coalesce(toxic, 0) = 1) GROUP BY source
UNION ALL SELECT source, 0, NULL, 'missing' FROM {LARGEST}""")
def idx_state(t: Tables) -> DataFrame:
    """Each file's state in the index: the commit that it is from, its chunks, and whether those are all of the file's."""
    live = generations.live(t.spark, replaced_store(t)).select("file", "rows", "number")
    there = t.documents.groupBy(F.col("source").alias("file")).agg(F.count("*").alias("there"))
    status = F.when(F.col("rows").isNull(), "missing").when(F.col("rows") == F.col("there"), "ready").otherwise("partial")
    return there.join(live, "file", "left").select("file", F.coalesce("rows", F.lit(0)).alias("chunks"), F.col("number").alias("generation"), status.alias("status"))


@query("""
SELECT doc_id AS chunk_id, source, 2::BIGINT AS generation, count(*) FILTER (lang = 'de') OVER () + 1 AS refused
FROM documents""")
def sink_publish_generation(t: Tables) -> DataFrame:
    """Three publishers work from the first index: one comes first, one too late, and one whose sources changed meanwhile. Of the
    late ones the rows that didn't get in are counted, with one for the publisher that saw the change."""
    root = new_root(t, "published")
    rows = t.documents.select(F.col("doc_id").alias("chunk_id"), "source")
    index_store.publish(t.documents.where("lang = 'en'").select(F.col("doc_id").alias("chunk_id"), "source"), root)
    started = generations.version(t.spark, root)
    before = generations.snapshot(rows)
    german = t.documents.where("lang = 'de'").select(F.col("doc_id").alias("chunk_id"), "source")
    refused = 0
    published = index_store.publish(rows, root, expected=started, ids=rows.select("chunk_id"))
    for late, more, weight in ((german, {"expected": started}, german.count()), (rows, {"expected": published, "unchanged": lambda: generations.snapshot(german) == before}, 1)):
        try:
            index_store.publish(late, root, **more)
        except generations.Conflict:
            refused += weight
    generation = generations.live(t.spark, root).select(F.col("number").alias("generation"))  # one row: the index is one file
    return index_store.current(t.spark, root).crossJoin(F.broadcast(generation)).withColumn("refused", F.lit(refused).cast("bigint"))
