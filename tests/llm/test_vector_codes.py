import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, part int, source string"


def brute(rows, parts=4, entries=256, rounds=4):
    """Plain integers, all distances."""
    kept = sorted([(i, [math.floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)], key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) if kept else 0
    kept = [r for r in kept if len(r[1]) == width]
    cut = [p * width // parts for p in range(parts + 1)]
    books = [[r[1][cut[p] : cut[p + 1]] for r in kept[:entries]] for p in range(parts)]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [r[1][cut[p] : cut[p + 1]] for r in kept]
            at = [nearest(books[p], x)[1] for x in own]
            books[p] = [[sum(c) // at.count(k) for c in zip(*(x for x, a in zip(own, at) if a == k))] if k in at else e for k, e in enumerate(books[p])]
    out = []
    for i, v, label in kept:
        found = [nearest(books[p], v[cut[p] : cut[p + 1]]) for p in range(parts)]
        out.append([i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)])
    total = {}
    for r in out:
        total[r[1]] = total.get(r[1], 0) + r[3]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, code, min(e, vector_codes.LONG), min(total[label], vector_codes.LONG), digest) for i, label, code, e in out), key=str)


def got(spark, rows, **more):
    codes, books = vector_codes.encode(spark.createDataFrame(rows, SCHEMA), **more)
    out = vector_codes.with_label_error(codes).withColumn("digest", F.lit(vector_codes.digest(books)))
    return sorted(map(tuple, out.select("vec_id", "code", "error", "label_error", "digest").collect()), key=str)


def rows_of(n, width, seed=0, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in (spread * rng.normal(size=width)).astype(np.float32)], None if i % 7 == 0 else i % 3, "x", 1, 2, "s") for i in range(n)]


def test_codes_match_brute_force(spark):
    rows = rows_of(420, 16)
    rows += [(1000 + i, rows[9][1], 1, "x", 1, 2, "s") for i in range(150)]  # one vector very often
    rows += [rows[3], (None, rows[4][1], 1, None, None, None, None), (2000, None, 1, "x", 1, 2, "s"), (2001, [None] * 16, 1, "x", 1, 2, "s"), (2002, [float("nan")] * 16, 1, "x", 1, 2, "s"), (2003, [float("inf")] * 16, 1, "x", 1, 2, "s"), (2004, [1.0] * 8, 1, "x", 1, 2, "s"), (2005, [], 1, "x", 1, 2, "s")]
    assert got(spark, rows) == brute(rows)


def test_few_rows_odd_lengths_and_large_components(spark):
    for rows in (rows_of(5, 16), rows_of(60, 10, 1), rows_of(40, 3, 2), rows_of(30, 8, 3, 1e6), rows_of(30, 8, 4, 1e11), [(i, [1.0, 2.0, 3.0, 4.0], 1, "x", 1, 2, "s") for i in range(9)]):
        assert got(spark, rows, rounds=2) == brute(rows, rounds=2)
    assert got(spark, []) == []
    assert [r[1] for r in got(spark, [(1, [], 1, "x", 1, 2, "s")])] == ["00000000"]


def test_bounds_never_exceed_the_distance_and_filter():
    rng = np.random.default_rng(7)
    for spread, shift in ((30, 0), (1000, 2_000_000), (1, 66_000_000), (20_000_000, 0)):
        entries = (shift + spread * rng.normal(size=(256, 16))).astype(np.int64)
        x = np.concatenate([(shift + spread * rng.normal(size=(200, 16))).astype(np.int64), entries[:50], entries[:30] + 1])
        at, far, looked = vector_codes.Book(entries).nearest(x)
        exact = ((x[:, None, :] - entries) ** 2).sum(2)
        assert (at == exact.argmin(1)).all() and (far == exact.min(1)).all()
        for blocks in vector_codes.BLOCKS:
            low = ((vector_codes.sketch(x, blocks)[:, None, :] - vector_codes.sketch(entries, blocks)) ** 2).sum(2)
            assert (low <= exact * (1 + 1e-6) + 1).all()
        assert looked.mean() < 256


def test_clustered_entries_are_mostly_filtered():
    rng = np.random.default_rng(8)
    entries = np.repeat(rng.integers(-4000, 4000, (256, 4)), 4, axis=1) + rng.integers(-50, 50, (256, 16))
    _, _, looked = vector_codes.Book(entries).nearest(entries[rng.integers(0, 256, 1000)] + rng.integers(-9, 9, (1000, 16)))
    assert looked.mean() < 256 / 10


def test_random_margins():
    rng = random.Random(1)
    for _ in range(50):
        k, width = rng.randint(1, 20), rng.randint(1, 9)
        entries = np.array([[rng.randint(-3, 3) for _ in range(width)] for _ in range(k)], np.int64)
        x = np.array([[rng.randint(-3, 3) for _ in range(width)] for _ in range(30)], np.int64)
        at, far, _ = vector_codes.Book(entries).nearest(x)
        exact = ((x[:, None, :] - entries) ** 2).sum(2)
        assert (at == exact.argmin(1)).all() and (far == exact.min(1)).all()
