import random
import re
from collections import Counter

import pytest

from sparkloom.llm import substring_dedup
from tests.llm.cases import SCHEMA, documents, empty, rows

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(texts, size):
    words = [WORD.findall((t or "").encode()) for t in texts]
    count = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        keep = [True] * len(w)
        for i in range(len(w) - size + 1):
            if count[tuple(w[i : i + size])] > 1:
                keep[i : i + size] = [False] * size
        out.append((len(w), keep.count(False), b" ".join(x for x, k in zip(w, keep) if k).decode()))
    return out


def check(spark, data, size):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.without_repeats(spark.createDataFrame(data, SCHEMA), size).collect())
    assert got == Counter((r[0], *x) for r, x in zip(data, brute([r[1] for r in data], size)))


@pytest.mark.parametrize("size", [35, 5, 12])
def test_matches_brute_force(spark, size):
    rng = random.Random(size)
    passages = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(60)] for _ in range(6)]
    data = []
    for i in range(150):
        words = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, 50)
            part = p[a : a + rng.randint(1, 60)]
            if rng.random() < 0.4 and part:
                part = part[:]
                part[rng.randrange(len(part))] = f"edit{rng.randint(0, 9)}"
            words += part + [f"u{rng.randint(0, 99999)}" for _ in range(rng.randint(0, 20))]
        if i % 17 == 0:
            words += ["same"] * 80 + ["x", "y"] * 45
        data.append((i, rng.choice([" ", "\n", " \t"]).join(words), None, None, None, None, None, None))
    check(spark, data + data[:3] + [(7, "other text of one id", None, None, None, None, None, None)], size)


def test_cases(spark):
    check(spark, rows(), 35)
    assert substring_dedup.without_repeats(empty(spark)).count() == 0
    spans = {r.doc_id: r.spans for r in substring_dedup.without_repeats(documents(spark), 6).collect()}
    assert [tuple(s) for s in spans[4]] == [(0, 6)] and spans[0] is None


def test_words_that_collide_under_linear_hashes_stay_apart(spark):
    morse = "a"
    while len(morse) < 1024:
        morse += morse.translate(str.maketrans("ab", "ba"))
    other = morse.translate(str.maketrans("ab", "ba"))
    shared = [f"w{i}" for i in range(34)]
    check(spark, [(i, " ".join(shared[:17] + [w] + shared[17:]), *[None] * 6) for i, w in enumerate((morse, other))], 35)
