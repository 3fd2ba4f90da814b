import pytest
from pyspark.sql import functions as F

from sparkloom.operators.recall import Policy, recall

FACTS = "id long, revision int, active boolean, scope string, category string, legacy boolean, importance double, freshness double, confidence double, usefulness double, text string"


def fact(i, **more):
    row = {"id": i, "revision": 1, "active": True, "scope": "a", "category": None, "legacy": False, "importance": 3.0, "freshness": 1.0, "confidence": 1.0, "usefulness": 0.0, "text": f"fact number {i}"}
    return tuple((row | more).values())


def ask(spark, facts, vectors, scopes=(), question=("nothing",), **policy):
    f = spark.createDataFrame(facts, FACTS)
    v = spark.createDataFrame(vectors, "id long, revision int, embedding array<double>")
    q = spark.range(1).select(F.array(F.lit(0.0), F.lit(0.0)).alias("q"))
    return recall(f, v, q, question, scopes, Policy(**policy)).orderBy("rank").collect()


def test_stale_vectors_leave_no_hole(spark):
    """The nearest hundred are of expired, edited or lost facts; the best of the rest fill the limit."""
    facts = [fact(i, active=i % 2 == 0, revision=2 if i % 2 == 0 else 1, importance=1.0) for i in range(60)] + [fact(i, importance=2.0) for i in range(100, 130)]
    vectors = [(i, 1, [i / 1000, 0.0]) for i in range(100)] + [(i, 1, [i / 10, 0.0]) for i in range(100, 130)] + [(100, None, [1.0, 0.0])]
    got = ask(spark, facts, vectors, limit=5, pool=10, least=1.5)
    assert [r.id for r in got] == [100, 101, 102, 103, 104] and all(r.similarity > 0 for r in got)
    assert got[0].similarity == pytest.approx(1 / 2.0)


def test_a_vector_without_revision_is_of_a_first_one(spark):
    facts = [fact(1), fact(2, revision=2), fact(3, revision=2)]
    got = ask(spark, facts, [(1, None, [0.0, 0.0]), (2, None, [0.0, 0.0]), (3, 2, [0.0, 0.0])])
    assert {r.id: r.similarity for r in got} == {1: 1.0, 2: 0.0, 3: 1.0}  # the second is only important


def test_scopes(spark):
    facts = [fact(1), fact(2, scope="b"), *(fact(i, scope=None) for i in range(10, 16)), fact(20, scope=None, category="Profile"), fact(21, scope=None, legacy=True), fact(22, scope=None, category="user_profile", legacy=True), fact(23, scope=None, legacy=None)]
    vectors = [(f[0], 1, [0.1, 0.0]) for f in facts]
    assert {r.id for r in ask(spark, facts, vectors, ["a"], limit=50)} == {1, 10, 11, 12, 20, 22}
    assert {r.id for r in ask(spark, facts, vectors, ["a"], limit=50, strict=True)} == {1, 20, 22}
    assert len(ask(spark, facts, vectors, limit=50)) == len(facts)


def test_what_bridges_is_placed_first(spark):
    facts = [fact(1, text="Anna leads Atlas"), fact(2, text="Atlas ships Friday", importance=1.0), fact(3, text="unlike", importance=5.0), fact(4, text="other", importance=5.0)]
    vectors = [(1, 1, [0.1, 0.0]), (2, 1, [9.0, 0.0]), (3, 1, [0.2, 0.0]), (4, 1, [0.3, 0.0])]
    got = ask(spark, facts, vectors, question=("anna",), limit=3, pool=3, hop=4)
    assert [(r.id, r.bridge is not None) for r in got] == [(1, True), (2, True), (3, False)]
    assert [r.id for r in ask(spark, facts, vectors, question=("nobody",), limit=3, pool=3, hop=4)] == [3, 4, 1]
    assert ask(spark, [], [], question=("anna",)) == []
