"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, start long, task int"


def rows() -> list[tuple]:
    long_text = " ".join(f"word{i % 911} of,the.line" for i in range(6000))
    texts = [None, "", " ", "a", "The quick brown fox.\nJumps over", "The quick brown fox.\nJumps over", long_text, "naïve café — 漢字, “x” password: hunter22x", "ab  cd\n\n\tef . , ,.", "<|endoftext|> it's 3.14 token=abc secret=abcdefg"]
    out = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, len(t) if t is not None else None, "x", 7, 9) for i, t in enumerate(texts)]
    return out + [out[4], (None, "no id", None, None, None, None, None, None)]


def documents(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
