"""A training corpus from raw documents, in five stages, each of which calls one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents, those of any other name too, unchanged but for
text and n_chars where secrets are masked. Ties go to the smaller doc_id. An empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import language_id, mixing, near_dedup, packing, secret_scan
from sparkloom.llm.common import release, table, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is near a learned language; what the classifier rejects goes, so null text, empty text and text
    without a letter too. Repeated rows stay or go together; a very long text is judged as a whole."""
    return language_id.accepted(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest doc_id; of repeated rows one stays. Null text
    and text without words, which the stage before takes out, would all stay."""
    return near_dedup.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets and linked credential parts replaced by a mark and n_chars brought up to date. Null text stays
    null with its n_chars; text without secrets is unchanged."""
    return secret_scan.redacted(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files and rows ordered so that sources interleave at their target weights. A null source is a
    source; repeated rows are just more rows."""
    return mixing.in_order(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences; pieces of one length are placed in the order of the mix, which packing reads
    from the numbers of files and rows. Null or empty text is a piece of one token, a very long one several pieces."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("near_dedup", without_near_copies),
    ("secret_scan", without_secrets),
    ("mixing", mixed_sources),
    ("packing", packed),
]

#: Learned models, sampling and tokenizers have no SQL form; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's input is deleted as soon as its own rows are written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name, bulky=True)
            if before is not None:
                release(before)
            before = docs
    return docs
