import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import chains


def walk(next_, start, depth):
    out, node, step = {start: 0}, start, 0
    while node in next_ and step < depth:
        node, step = next_[node], step + 1
        if node in out:
            break
        out[node] = step
    return out


def graphs():
    rng = random.Random(3)
    yield {}
    yield {1: 2}
    yield {i: i + 1 for i in range(70)}
    yield {1: 2, 2: 3, 3: 1, 9: 1, 8: 9}
    for _ in range(3):
        yield {i: rng.randrange(40) for i in rng.sample(range(40), 30)}


@pytest.mark.parametrize("next_", list(graphs()), ids=str)
def test_reaches_and_heads_match_a_walk(spark, next_):
    next_ = {k: v for k, v in next_.items() if k != v}
    rows = [(k, v) for k, v in next_.items()] + [(500, 500), (None, 3), (4, None)]
    links = spark.createDataFrame(rows, "source long, target long")
    nodes = set(next_) | set(next_.values())
    for depth in (1, 5, 100):
        got = {(r.start, r.node, r.step) for r in chains.reaches(links, depth).collect()}
        assert got == {(s, n, k) for s in nodes for n, k in walk(next_, s, depth).items()}
    heads = {r.node: (r.head, r.steps) for r in chains.heads(links).collect()}
    for node in nodes:
        path = walk(next_, node, 1000)
        last = max(path, key=path.get)
        if last not in next_:
            assert heads[node] == (last, path[last])
        else:
            assert heads[node] == (min(walk(next_, last, 1000)), None)
    assert set(heads) == nodes


def test_timelines_go_both_ways(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "c")], "source string, target string")
    got = {(r.start, r.node): r.step for r in chains.timelines(links, 20).collect()}
    assert got == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 2, ("b", "a"): -1, ("b", "b"): 0, ("b", "c"): 1, ("c", "a"): -2, ("c", "b"): -1, ("c", "c"): 0, ("c", "x"): -1, ("x", "x"): 0, ("x", "c"): 1}


def test_of_several_targets_the_smallest_counts(spark):
    links = spark.range(5).select(F.lit(1).alias("source"), (F.col("id") + 2).alias("target"))
    assert {(r.node, r.step) for r in chains.reaches(links, 9).where("start = 1").collect()} == {(1, 0), (2, 1)}


def test_rounds_follow_the_longest_chain_and_not_the_table(spark, monkeypatch):
    made = []
    monkeypatch.setattr(chains, "persisted", lambda df: made.append(1) or df.localCheckpoint())
    links = spark.range(4000).selectExpr("id * 2 AS source", "id * 2 + 1 AS target")
    found = chains.heads(links)
    assert found.where("head = node + 1 AND steps = 1").count() == 4000 and found.count() == 8000
    assert len(made) < 6


def test_steps_are_listed_only_at_the_end(spark, monkeypatch):
    made = []
    monkeypatch.setattr(chains, "persisted", lambda df: made.append(df.localCheckpoint()) or made[-1])
    next_ = {i: i + 1 for i in range(300)} | {i: i + 1 for i in range(400, 440)} | {440: 410, 500: 10, 501: 500}
    links = spark.createDataFrame(list(next_.items()), "source long, target long")
    nodes = set(next_) | set(next_.values())
    for depth in (0, 2, 3, 64, 100):
        made.clear()
        got = [(r.start, r.node, r.step) for r in chains.reaches(links, depth).collect()]
        assert sorted(got) == sorted((s, n, k) for s in nodes for n, k in walk(next_, s, depth).items())
        assert max(df.count() for df in made) <= len(nodes)
