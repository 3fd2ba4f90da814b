import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import permutation_index

SCHEMA = "vec_id long, embedding array<float>, label int, q long, segment string"


def brute(rows, k, every):
    ok = {i: np.array(v, np.float32).astype(float) for i, v, *_ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for i in ok:
        if i % every == 0:
            found = sorted((float(np.sqrt(((ok[j] - ok[i]) ** 2).sum())), j) for j in ok if j != i)
            out[i] = found[:k]
    return out


def test_recall_ties_and_unusable_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[500:1100] = x[500]  # many copies, among them queries
    x[1100:1500] = x[1100] + 1e-3 * rng.normal(size=(400, 16))
    rows = [(i, v.tolist(), 1, 2, "x") for i, v in enumerate(x)]
    rows += [(5000, None, 1, 2, "x"), (5100, [0.0] * 16, 1, 2, "x"), (5200, [float("nan")] * 16, 1, 2, "x"), (5300, [None] * 16, 1, 2, "x"), (None, [1.0] * 16, 1, 2, "x"), rows[0]]
    got = {}
    for r in permutation_index.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    want = brute(rows, 10, 20)
    assert set(got) == set(want)
    hits = 0
    for i, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and [x[1:] for x in found] == sorted(x[1:] for x in found)
        hits += len({(round(s, 9), j) for _, s, j in found} & {(round(s, 9), j) for s, j in want[i]})
    assert hits >= 0.95 * 10 * len(want)
    for i in (520, 1120):  # copies and dense groups are exact
        assert [(pytest.approx(s), j) for _, s, j in got[i]] == want[i]


def test_fewer_candidates_and_empty(spark):
    few = [(0, [1.0, 0.0], 1, 1, "x"), (100, [0.0, 1.0], 1, 1, "x"), (7, [0.0, 2.0], 1, 1, "x")]
    got = sorted(map(tuple, permutation_index.search(spark.createDataFrame(few, SCHEMA), F.col("vec_id") % 100 == 0).collect()))
    assert [r[:3] for r in got] == [(0, 1, 100), (0, 2, 7), (100, 1, 7), (100, 2, 0)]
    assert permutation_index.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).count() == 0


def test_vectors_of_each_length_meet_their_own(spark):
    rows = [(i, [float(i)] * (2 + i % 2), 1, 1, "x") for i in range(1, 40)] + [(100, [3.5, 3.5], 1, 1, "x")]
    got = sorted(map(tuple, permutation_index.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, 2).collect()))
    assert [r[:3] for r in got] == [(20, 1, 18), (20, 2, 22), (100, 1, 4), (100, 2, 2)]


def test_lists_give_the_footrule():
    rng = np.random.default_rng(1)
    x, pivots = rng.normal(size=(300, 8)), rng.normal(size=(90, 8))
    order = permutation_index.orders(x, pivots)
    m = order.shape[1]
    posted = {}
    for p, (rows, places) in enumerate(permutation_index.lists(order, 90)):
        posted[p] = np.zeros(300, np.uint8)
        posted[p][rows] = m - places
    place = np.full((300, 90), m)
    for i, o in enumerate(order):
        place[i, o] = np.arange(m)
    for i in range(0, 300, 37):
        footrule = np.abs(place - place[i]).sum(1)
        assert (m * (m + 1) - 2 * permutation_index.agreement(posted, order[i], 300).astype(int) == footrule).all()


def test_recall_on_a_hundred_thousand_vectors_without_structure(spark):
    rows = spark.range(100_000).select(F.col("id").alias("vec_id"), F.array(*(F.randn(i).cast("float") for i in range(64))).alias("embedding")).toArrow()
    x = rows.column("embedding").combine_chunks().flatten().to_numpy().reshape(-1, 64).astype(float)
    got = {}
    for r in permutation_index.search(spark.createDataFrame(rows), F.col("vec_id") % 1000 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for i in range(0, 100_000, 1000):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        hits += len(got[i] & set(np.argpartition(d, 10)[:10].tolist()))
    print("recall", hits / 1000)
    assert hits >= 0.9 * 1000
