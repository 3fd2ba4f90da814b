"""Texts that say the same: equal values, negations and words, and nearly equal characters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import persisted

# What must be equal in both texts, in lower case.
VALUES = r"(?<![\p{L}\p{N}_])(?:[$€£¥]\s*)?[-+]?[0-9][0-9,]*(?:\.[0-9]+)?(?:\s*%|\s*(?:usd|eur|gbp|cny))?"
NEGATED = r"\b(?:not|no|never|neither|without|cannot|can't|won't|isn't|aren't|didn't|doesn't)\b|不|未|无|没有|禁止|取消|并非|不能"


def signature(c: Column) -> Column:
    """Equal only for texts with the same values, negations and words in the same order."""
    low = F.lower(c)
    parts = (T.matches(low, VALUES), T.matches(low, NEGATED), T.tokens(c))
    return F.sha2(F.concat_ws("\x1e", *(F.concat_ws("\x1f", p) for p in parts)), 256)


def shared_ngrams(a: Column, b: Column, size: Column, sizes: tuple[int, ...]) -> Column:
    """Overlap of the character n-grams of two texts, n being one of ``sizes``; equal texts need no n-grams."""
    equal = F.when(F.trim(F.lower(a)) == F.trim(F.lower(b)), 1.0)
    return reduce(lambda c, n: c.when(size == n, T.overlap_coefficient(T.char_ngrams(a, n), T.char_ngrams(b, n))), sizes, equal)


def keep_first(docs: DataFrame, rank: str, text: str, least: float, size: int | None = None) -> DataFrame:
    """(rank, head): the head is the first kept text that a text repeats, itself if it is kept.

    As if texts came one by one in the order of ``rank``, which is unique: a text goes if it is near one that was kept. In
    each round the first text left of every signature is kept and takes all near it along, so a round compares a text with
    one other, and no pairs of a group are listed. ``size`` is n, by default by the length of the later text. Null and blank
    texts never repeat another.
    """
    marked = docs.select(F.col(rank).alias("rank"), F.col(text).alias("text"), (F.trim(F.coalesce(text, F.lit(""))) == "").alias("blank"))
    marked = marked.withColumn("variant", F.when(~F.col("blank"), F.sha2(F.trim(F.lower("text")), 256)))
    keys = persisted(marked.select("rank", "variant", F.when(~F.col("blank"), signature(F.col("text"))).alias("sig")))
    variants = keys.where("sig IS NOT NULL").groupBy("sig", "variant").agg(F.min("rank").alias("rank"))
    several = variants.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1").select("sig")
    left = persisted(variants.join(several, "sig", "left_semi").join(marked.select("rank", "text"), "rank"))
    heads = variants.join(several, "sig", "left_anti").select("sig", "variant", F.col("rank").alias("head"))
    n = T.ngram_size(F.col("text")) if size is None else F.lit(size)
    while not left.isEmpty():
        first = left.groupBy("sig").agg(F.min(F.struct("rank", "text")).alias("first"))
        same = shared_ngrams(F.col("text"), F.col("first.text"), n, (3, 4, 5) if size is None else (size,)) >= least
        met = persisted(left.join(first, "sig").select("sig", "variant", "rank", "text", F.col("first.rank").alias("head"), same.alias("same")))
        heads = heads.unionByName(met.where("same").select("sig", "variant", "head"))
        left = met.where("NOT same").select("sig", "variant", "rank", "text")
    return keys.join(heads, ["sig", "variant"], "left").select("rank", F.coalesce("head", "rank").alias("head"))


def sql(least: float, size: int | None = None) -> str:
    """The same over documents by DuckDB, one text of a signature after the other; columns doc_id, kept and source."""
    n = "CASE WHEN length(w.text) < 100 THEN 3 WHEN length(w.text) > 1000 THEN 5 ELSE 4 END" if size is None else str(size)
    grams = "CASE WHEN length({0}) <= {1} THEN [{0}] ELSE list_distinct(list_transform(range(1, length({0}) - {1} + 2), lambda i: substr({0}, i, {1}))) END"
    a, b = grams.format("w.t", "w.n"), grams.format("x.t", "w.n")
    near = f"len(list_intersect({a}, {b})) / least(len({a}), len({b})) >= {least}"
    values, negated = (p.replace("'", "''").replace(r"(?<![\p{L}\p{N}_])", r"(?:^|[^\p{L}\p{N}_])") for p in (VALUES, NEGATED))
    sig = rf"concat_ws(chr(30), array_to_string(regexp_extract_all(t, '{values}'), chr(31)), array_to_string(regexp_extract_all(t, '{negated}'), chr(31)), array_to_string(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+'), chr(31)))"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, source, text, trim(lower(text)) AS t FROM documents WHERE trim(text) <> ''),
 v AS (SELECT md5({sig}) AS sig, t, min(doc_id) AS doc_id, arg_min(text, doc_id) AS text FROM d GROUP BY 1, 2),
 w AS (SELECT *, {n.replace('w.', '')} AS n, row_number() OVER (PARTITION BY sig ORDER BY doc_id) AS p FROM v),
 g AS (SELECT sig, t, p, doc_id AS head, [{{'id': doc_id, 't': t}}] AS kept FROM w WHERE p = 1
  UNION ALL SELECT sig, t, p, coalesce(h, doc_id), CASE WHEN h IS NULL THEN list_append(kept, {{'id': doc_id, 't': t}}) ELSE kept END
  FROM (SELECT w.sig, w.t, w.p, w.doc_id, g.kept, list_filter(g.kept, lambda x: {near})[1].id AS h FROM g JOIN w ON w.sig = g.sig AND w.p = g.p + 1))
 SELECT a.doc_id, coalesce(g.head, a.doc_id) AS kept, a.source FROM documents a LEFT JOIN g ON g.t = trim(lower(a.text))"""
