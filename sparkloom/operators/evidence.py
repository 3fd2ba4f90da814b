"""Which remembered facts may be used: those whose evidence still stands in its file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

REFS = "array<struct<file_id bigint, meeting_id string, source_revision string, window_start int, window_end int>>"


def plain_space(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


def admissible(memories: DataFrame, files: DataFrame) -> DataFrame:
    """Keys of memories (key, made, value, excerpt, refs and file_ids as JSON) that may enter a context, each once.

    What no machine made stays. Of the rest, what holds a directive in value or excerpt goes; without references, it stays only
    if it names no files, as talk does. Otherwise one reference has to hold: to a file of project state, of the named meeting and
    revision (null: any), with the excerpt exactly once in its window, whatever the white space. Texts meet references by file,
    so a file's text moves once for each fact that cites it. Null or unreadable JSON is an empty list.

    ``files``: file_id, meeting_id, policy, revisions (array of strings), text.
    """
    automatic = F.coalesce(F.col("made").isin("auto_extracted", "consolidated"), F.lit(False))
    clean = ~F.coalesce(T.has_directive(F.col("value")), F.lit(False)) & ~F.coalesce(T.has_directive(F.col("excerpt")), F.lit(False))
    entries = lambda c, schema: F.coalesce(F.from_json(c, schema), F.array().cast(schema))
    talk = clean & (F.size(entries("refs", REFS)) == 0) & (F.size(entries("file_ids", "array<bigint>")) == 0)
    free = memories.where(~automatic | talk).select("key")

    quoted = memories.where(automatic & clean).select("key", F.trim(plain_space(F.col("excerpt"))).alias("excerpt"), F.explode(entries("refs", REFS)).alias("ref")).where("excerpt <> ''")
    cited = quoted.select("key", "excerpt", "ref.*").withColumnRenamed("meeting_id", "wanted")
    start, end = F.coalesce("window_start", F.lit(0)), F.coalesce("window_end", F.length("text"))
    stands = (
        (F.col("wanted").isNull() | (F.col("wanted") == F.col("meeting_id")))
        & (F.coalesce("source_revision", F.lit("")).eqNullSafe("") | F.array_contains("revisions", F.col("source_revision")))
        & (end <= F.length("text")) & (end > start)
    )
    found = cited.join(files.where("policy = 'project_state'"), "file_id").where(stands)
    body = found.select("key", "excerpt", plain_space(F.substring("text", start + 1, end - start)).alias("body"))
    once = F.length("body") - F.length(F.replace("body", "excerpt")) == F.length("excerpt")
    return free.unionByName(body.where(once).select("key")).distinct()
