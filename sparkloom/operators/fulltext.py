"""Full-text ranking: an inverted index as a DataFrame and BM25 over it.

score = sum over query terms of ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average)).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words

K1, B = 1.2, 0.75


def equals(word: str):
    return lambda x: x == F.lit(word)


def postings(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(key, term, tf) and (key, length). Terms are counted before their exchange."""
    terms = docs.select(key, words(F.col(text)).alias("terms"))
    return terms.select(key, F.explode("terms").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf")), terms.select(key, F.size("terms").alias("length"))


def stats(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("documents"), F.avg("length").alias("average"))


def search(docs: DataFrame, key: str, text: str, terms: Sequence[str], k1: float = K1, b: float = B) -> DataFrame:
    """key and score of documents with any of the terms.

    With the terms known, each document counts just these, in one pass and without an exchange of postings; document
    frequencies and lengths are sums over that pass, one row, which is all that is broadcast.
    """
    own = docs.select(key, words(F.col(text)).alias("w"))
    counted = own.select(key, F.size("w").alias("length"), *(F.size(F.filter("w", equals(q))).alias(f"tf{i}") for i, q in enumerate(terms)))
    total = counted.agg(F.count("*").alias("n"), F.avg("length").alias("average"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    scored = counted.where(" OR ".join(f"tf{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(total))
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        score = score + F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("average")))
    return scored.select(key, score.alias("score"))


def search_postings(index: DataFrame, lengths: DataFrame, key: str, queries: DataFrame) -> DataFrame:
    """(query_id, key, score) for many queries (query_id, term) over a stored index: joins on term, then on key."""
    total = stats(lengths)
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    hits = queries.distinct().join(df, "term").join(index, "term").join(lengths, key).crossJoin(F.broadcast(total))
    tf = F.col("tf")
    part = F.log(1 + (F.col("documents") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("average")))
    return hits.groupBy("query_id", key).agg(F.sum(part).alias("score"))


def sql(terms: Sequence[str], docs: str = "documents") -> str:
    """The same by DuckDB."""
    tf = [f"len(list_filter(w, lambda x: x = '{q}'))" for q in terms]
    parts = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * {K1 + 1} / (tf{i} + {K1} * (1 - {B} + {B} * length / average))" for i in range(len(terms)))
    counted = f"SELECT doc_id, len(w) AS length, {', '.join(f'{x} AS tf{i}' for i, x in enumerate(tf))} FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM {docs})"
    return f"WITH c AS ({counted}), s AS (SELECT count(*) AS n, avg(length) AS average, {', '.join(f'count(*) FILTER (tf{i} > 0) AS df{i}' for i in range(len(terms)))} FROM c) SELECT doc_id, ({parts})::DOUBLE AS score FROM c, s WHERE {' OR '.join(f'tf{i} > 0' for i in range(len(terms)))}"
