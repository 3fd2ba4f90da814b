"""Near duplicates against texts taken one by one, and resolved conflicts case by case."""

import random
import re

import pytest

from sparkloom.operators import duplicates, upserts

rng = random.Random(11)
WORDS = "the launch budget of atlas is 120 150 approved not never friday after review".split()
MARKS = [" ", ", ", " - ", "; ", "  ", " ... ", "!!! ", " (", ") "]
BASES = [[rng.choice(WORDS) for _ in range(rng.randint(1, 9))] for _ in range(12)] + [["Ünï", "3.5", "%"], ["a"]]


def written(words):
    return "".join(w + rng.choice(MARKS) for w in words)


TEXTS = [written(rng.choice(BASES)) for _ in range(150)] + ["", "   ", None, None, "!!!", "...", "!!!", "budget $120,000", "budget $150,000", "1.5", "1 5", "The Same", "the same", "x" * 1200, "x" * 1200 + "!"]


def plain_heads(texts, least, size):
    def grams(t, n):
        t = t.lower().strip(" ")
        return {t} if len(t) <= n else {t[i : i + n] for i in range(len(t) - n + 1)}

    def signed(t):
        low = t.lower()
        return re.findall(r"(?<!\w)(?:[$€£¥]\s*)?[-+]?\d[\d,]*(?:\.\d+)?(?:\s*%|\s*(?:usd|eur|gbp|cny))?", low), [w for w in re.findall(r"\w+", low) if w in ("not", "never", "no")], re.findall(r"\w+", low)

    kept, heads = [], {}
    for i, t in enumerate(texts):
        heads[i] = i
        if t is None or not t.strip(" "):
            continue
        n = size or (3 if len(t) < 100 else 5 if len(t) > 1000 else 4)
        for j in kept:
            a, b = grams(t, n), grams(texts[j], n)
            if signed(t) == signed(texts[j]) and len(a & b) / min(len(a), len(b)) >= least:
                heads[i] = j
                break
        else:
            kept.append(i)
    return heads


@pytest.mark.parametrize("least,size", [(0.92, None), (0.85, 4), (0.5, 3)])
def test_keep_first_is_as_one_by_one(spark, least, size):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    got = {r.rank: r["head"] for r in duplicates.keep_first(docs, "id", "text", least, size).collect()}
    want = plain_heads(TEXTS, least, size)
    assert got == want
    assert len(set(want.values())) < len(TEXTS)


def test_keep_first_of_nothing(spark):
    assert duplicates.keep_first(spark.createDataFrame([], "id long, text string"), "id", "text", 0.9).collect() == []


def test_conflicts_resolve_only_as_declared(spark):
    facts = [("a", "p", 1, "pending", None), ("b", "p", 1, "pending", "old"), ("c", "p", 2, "pending", None), ("d", "q", 1, "pending", None), ("e", None, 1, "retracted", None), ("f", "p", 1, "pending", None), ("g", None, 1, "pending", None)]
    declared = [("a", "b"), ("a", "g"), ("c", "d"), ("d", "e"), ("f", "a"), ("f", "b"), ("b", "c"), ("g", "missing")]
    requested = [("a", "b"), ("a", "g"), ("c", "d"), ("d", "e"), ("f", "a"), ("b", "c"), ("g", "missing")]
    requests = [("a", 1, "now"), ("c", 2, "now"), ("d", 1, "now"), ("f", 1, "now"), ("b", 9, "now"), ("g", 1, "now"), ("gone", 1, "now")]
    pairs = "winner string, loser string"
    out = upserts.resolved(
        spark.createDataFrame(facts, "key string, project string, revision long, status string, valid_to string"),
        spark.createDataFrame(requests, "winner string, expected_revision long, at string"), spark.createDataFrame(declared, pairs), spark.createDataFrame(requested, pairs),
    )
    got = {r.key: (r.revision, r.status, r.valid_to, r.superseded_by) for r in out.collect()}
    same = {k: (r, s, v, None) for k, _, r, s, v in facts}
    # c and d are of two projects, e is retracted, f names fewer than it declared, b has another revision, g names no fact
    assert got == same | {"a": (2, "confirmed", None, None), "b": (2, "superseded", "old", "a"), "g": (2, "superseded", "now", "a")}


def test_upsert_takes_the_last_of_a_batch(spark):
    index = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, v string")
    batch = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1), (4, None, 1)], "id long, v string, n long")
    from pyspark.sql import functions as F

    assert sorted(map(tuple, upserts.upserted(index, batch, "id", [F.desc("n")]).collect())) == [(1, "a"), (2, "d"), (3, "e"), (4, None)]
