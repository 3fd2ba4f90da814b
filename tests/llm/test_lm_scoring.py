import math
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import common, lm_scoring
from tests.llm.cases import SCHEMA, documents, empty


def corpus():
    rng = np.random.default_rng(4)
    good, bad = "alpha beta gamma delta epsilon".split(), "noise junk spam alpha zeta".split()
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad, int(rng.integers(1, 40)))), None, None, None, None, None, None) for i in range(200)]
    return rows + rows[:2] + [(900, None, *[None] * 6), (901, "Solo", *[None] * 6), (None, "alpha beta", *[None] * 6)]


def brute(data, good):
    words = [[w.lower() for w in (r[1] or "").split()] for r in data]
    size = len({x for w in words for x in w}) + any(words)
    out = []
    for i, (own, w) in enumerate(zip(data, words)):
        losses = []
        models = []
        for k in range(2):
            single, pair, n = Counter(), Counter(), 0
            for j, (r, v) in enumerate(zip(data, words)):
                if j != i and (k or r[0] in good):
                    n += len(v)
                    single.update(["<s>", *v] if v else [])
                    pair.update(zip(["<s>", *v], v))
            models.append((single, pair, n))
        for single, pair, n in models:
            scale = models[0][2] / max(n, 1)
            p = [(pair[a, b] * scale + lm_scoring.PRIOR * (single[b] * scale + 1) / (models[0][2] + size)) / (single[a] * scale + lm_scoring.PRIOR) for a, b in zip(["<s>", *w], w)]
            losses.append(-sum(map(math.log, p)) / len(p) if p else None)
        out.append((own[0], len(w), losses[0], losses[1], losses[0] - losses[1] if w else None))
    return out


@pytest.mark.parametrize("chunk, bucket", [(1 << 24, 1 << 20), (200, 50)])
def test_matches_brute_force(spark, monkeypatch, chunk, bucket):
    for module in (lm_scoring, common):
        monkeypatch.setattr(module, "CHUNK" if module is lm_scoring else "CHUNK_BYTES", chunk)
    monkeypatch.setattr(lm_scoring, "BUCKET", bucket)
    data = corpus()
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(0, 200, 1) if i % 5] + [(1, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    good = {i for i in range(200) if i % 5 and i % 2}
    got = sorted(map(tuple, lm_scoring.score(spark.createDataFrame(data, SCHEMA), labels).collect()), key=str)
    for a, b in zip(got, sorted(brute(data, good), key=lambda r: str((r[0], r[1])))):
        assert a[:2] == b[:2]
        assert all((x is None and y is None) or x == pytest.approx(y, rel=1e-5, abs=1e-6) for x, y in zip(a[2:], b[2:]))
    means = {k: np.mean([r[4] for r in got if r[0] is not None and r[0] < 200 and r[0] % 2 == k]) for k in (0, 1)}
    assert means[1] < 0 < means[0] - means[1] - 0.5


def test_counts_are_packed_without_loss():
    rng = np.random.default_rng(2)
    for x in (np.zeros(0, np.uint64), rng.integers(0, 1 << 64, 1000, dtype=np.uint64), rng.integers(0, 5, 77).astype(np.int64)):
        assert (lm_scoring.unpacked(lm_scoring.packed(x)) == x).all()


def test_cases(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert lm_scoring.score(empty(spark), none).count() == 0
    out = lm_scoring.score(documents(spark), none).collect()
    assert len(out) == 12 and {r.score for r in out if r.n_tokens == 0} == {None}
