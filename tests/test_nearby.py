import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import entities, graph, nearby


def vectors(n=260, d=6, seed=4):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, d))
    x = [(centers[i % 12] + 0.15 * rng.normal(size=d)).tolist() for i in range(n)]
    x[5], x[17], x[30] = x[4], x[4], None
    return [(i, v, "a" if i % 3 else None) for i, v in enumerate(x)] + [(900, [0.0] * d, "a")]


SCHEMA = "id long, x array<double>, kind string"


@pytest.mark.parametrize("radius", [0.0, 0.3, 0.6, 5.0])
def test_pairs_match_brute_force(spark, radius):
    rows = vectors()
    nodes, members = nearby.nodes_of(spark.createDataFrame(rows, SCHEMA), "id", "x", ["kind"])
    node = {r.id: r.node for r in members.collect()}
    assert node[5] == node[5] and set(node) == {i for i, v, _ in rows if v is not None}
    got = {frozenset((r.u, r.v)) for r in nearby.close_pairs(nodes, radius, ["kind"], pivots=9).collect()}
    count = nearby.close_pairs(nodes, radius, ["kind"], pivots=9).count()
    want = {frozenset((node[a], node[b])) for (a, x, k), (b, y, m) in itertools.combinations(rows, 2) if x is not None and y is not None and k == m and node[a] != node[b] and math.dist(x, y) <= radius}
    assert got == want and count == len(want)


def test_few_pairs_are_compared_where_vectors_cluster(spark):
    rows = vectors(1200, 8)
    nodes, _ = nearby.nodes_of(spark.createDataFrame(rows, SCHEMA), "id", "x")
    n = nodes.count()
    compared = nearby.candidates(nodes, 0.25).count()
    assert compared < n * (n - 1) / 2 / 10


def test_cosine_pairs_match_brute_force(spark):
    rows = vectors()
    unit = spark.createDataFrame(rows, SCHEMA).withColumn("x", nearby.unit(F.col("x")))
    nodes, members = nearby.nodes_of(unit, "id", "x")
    node = {r.id: r.node for r in members.collect()}
    assert 900 not in node
    for least in (0.95, 0.5):
        got = {frozenset((r.u, r.v)) for r in nearby.cosine_pairs(nodes, least).collect()}
        cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
        want = {frozenset((node[a], node[b])) for (a, x, _), (b, y, _) in itertools.combinations([r for r in rows if r[0] in node], 2) if node[a] != node[b] and cos(x, y) >= least}
        assert got == want


def components(nodes, links):
    at = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(at[a], at[b])
            changed |= at[a] != low or at[b] != low
            at[a] = at[b] = low
    return at


def test_sets_match_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(25)]
    rows = [(i, sorted(set(["every", *rng.choices(words, [1 / (k + 1) for k in range(25)], k=rng.randint(0, 7))]))) for i in range(150)]
    rows += [(500, []), (501, ["every"]), (502, ["every"]), (503, None), (504, ["w1", "w1"])]
    df = spark.createDataFrame(rows, "k long, w array<string>")
    for least in (0.75, 0.5, 1.0):
        close = [(a, b) for (a, s), (b, t) in itertools.combinations(rows, 2) if s and t and len(set(s) & set(t)) / min(len(set(s)), len(set(t))) >= least - 1e-12]
        want = components([k for k, _ in rows], close)
        assert {r.k: r.component for r in graph.token_clusters(df, "k", "w", least).collect()} == want


def test_a_common_token_lists_few_pairs(spark):
    rows = [(i, ["every", *(f"t{i * 5 + j}" for j in range(5))]) for i in range(400)] + [(900 + i, ["every", "all", f"u{i}", "v"]) for i in range(2)]
    sets = spark.createDataFrame(rows, "node long, s array<string>")
    plan = graph.overlapping(sets)
    assert {(r.u, r.v) for r in plan.collect()} == {(900, 901)}


def test_entities_and_relations(spark):
    rows = [
        (1, "Ada", "person", [0.0, 0.0], None, 5),
        (2, "ada l.", "person", [0.4, 0.0], None, 1),
        (3, "Countess", "person", [1.0, 0.0], [" ADA L. "], 9),
        (4, "Ada", "machine", [0.0, 0.0], None, 0),
        (5, "Byron", "person", [1.6, 0.0], ["nobody"], 0),
        (6, "none", "person", None, ["Ada"], 0),
        (7, "twin", None, [9.0, 9.0], [], 2),
        (8, "twin", None, [9.0, 9.0], [], 1),
    ]
    df = spark.createDataFrame(rows, "id long, name string, type string, vector array<double>, aliases array<string>, seen int")
    got = {r.id: r.canonical for r in entities.canonical(df, 0.5, ["type"], "seen").collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 4, 5: 5, 6: 6, 7: 8, 8: 8}
    assert {r.id: r.canonical for r in entities.canonical(df, 0.3, ["type"]).collect()}[2] == 2
    relations = spark.createDataFrame([(1, 1, "knows", 5, 0.5), (2, 3, "knows", 5, 0.9), (3, 2, "knows", 1, 0.1), (4, 5, "knows", 77, None), (5, 2, "knows", 5, 0.9)], "id long, subject long, predicate string, object long, confidence double")
    mapping = spark.createDataFrame(list(got.items()), "id long, canonical long")
    assert {tuple(r) for r in entities.repointed(relations, mapping).collect()} == {(2, "knows", 5, 0.9, 2, 3), (2, "knows", 2, 0.1, 3, 1), (5, "knows", 77, None, 4, 1)}


def test_tiles_match_brute_force_and_compare_no_row_by_row(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = [v.tolist() for v in rng.normal(size=(700, 5))] + [[float("nan")] * 5, [float("inf")] * 5, [1.0, 2.0]]
    rows = [(i, v, "a" if i % 4 else None) for i, v in enumerate(x)]
    monkeypatch.setattr(nearby, "TILE", 128)
    nodes = spark.createDataFrame(rows, "node long, x array<double>, kind string")
    found = nearby.close_pairs(nodes, 0.7, ["kind"])
    got = [frozenset((r.u, r.v)) for r in found.collect()]
    want = {frozenset((a, b)) for (a, p, k), (b, q, m) in itertools.combinations(rows[:700], 2) if k == m and math.dist(p, q) <= 0.7}
    assert set(got) == want and len(got) == len(want) > 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "MapInArrow" in plan


def test_unit_binds_its_norm(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "id long, x array<float>").select("id", nearby.unit(F.col("x")).alias("u"))
    assert {r.id: r.u for r in df.collect()} == {1: [0.6, 0.8], 2: None, 3: None}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("SQRT") == 1
