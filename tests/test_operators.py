import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import fulltext, graph, history, ranking
from sparkloom.sources import files, index_store
from sparkloom.streaming import events as S


def test_graph_components(spark):
    nodes = spark.range(1, 60).withColumnRenamed("id", "node")
    links = spark.createDataFrame([(i, i + 1) for i in range(10, 40)] + [(3, 2), (2, 1), (50, 51)], "u long, v long")
    got = {r.node: r.component for r in graph.components(nodes, links).collect()}
    assert got[40] == 10 and got[3] == 1 and got[51] == 50 and got[59] == 59
    words = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, ["a", "b", "c"]), (3, ["x"]), (4, []), (5, ["x"])], "k long, w array<string>")
    assert {r.k: r.component for r in graph.token_clusters(words, "k", "w").collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 3}


def test_stored_index_gives_the_same_scores(spark):
    docs = spark.createDataFrame([(1, "red red fox"), (2, "blue fox"), (3, "red"), (4, "")], "id long, text string")
    a = {r.id: r.score for r in fulltext.search(docs, "id", "text", ["red", "fox"]).collect()}
    index, lengths = fulltext.postings(docs, "id", "text")
    asked = spark.createDataFrame([(0, "red"), (0, "fox")], "query_id long, term string")
    b = {r.id: r.score for r in fulltext.search_postings(index, lengths, "id", asked).collect()}
    assert a.keys() == b.keys() == {1, 2, 3} and all(a[k] == pytest.approx(b[k]) for k in a)


def test_retracted_latest_hides_older(spark):
    rows = spark.createDataFrame([("k", 1, 1, None, 1, "ok"), ("k", 2, 2, None, 2, "retracted"), ("j", 1, 1, 5, 9, "ok")], "k string, revision int, valid_from int, valid_to int, recorded_at int, status string")
    got = history.as_of(rows, ["k"], F.lit(3), F.lit(4), [F.desc("revision")]).collect()
    assert [(r.k, r.status) for r in got] == [("k", "retracted")]
    assert history.as_of(rows, ["k"], F.lit(5), F.lit(9), [F.desc("revision")]).where("k = 'j'").isEmpty()


def test_evidence_modes_and_eviction(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate((1.0, 0.5, 0.5, 0.1))], "id long, score double")
    keep = lambda mode, x, **k: sorted(r.id for r in ranking.evidence(df, mode, x, ranking.best_first("score", "id"), **k).collect())
    assert keep("absolute", 0.5) == [0, 1, 2] and keep("ratio", 0.6) == [0] and keep("percentile", 0.5) == [0, 1] and keep("ratio", 0.6, protected=F.col("id") == 3) == [0, 3]
    scope = spark.createDataFrame([(10 + i, i) for i in range(1, 5)], "file long, rank int")
    got = ranking.evicted(scope, spark.createDataFrame([(11,), (90,), (91,), (92,)], "file long"), "file", 4, 2).orderBy("rank").collect()
    assert [r.file for r in got] == [90, 11, 91, 12] or {r.file for r in got} == {11, 90, 91, 12}


def test_chain_ends_in_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "source long, target long")
    assert {(r.node, r.step) for r in history.chain(edges, [1], 10).collect()} == {(1, 0), (2, 1), (3, 2)}


def test_cjk_terms(spark):
    row = spark.createDataFrame([("東京会議 the AI 中 データ",)], "t string").select(T.fts_terms(F.col("t"))).first()[0]
    assert set(row) == {"東京会", "京会議", "the", "中", "データ"}


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,"y, z"\n1,2')
    (tmp_path / "b.html").write_text("<b>hi</b> there")
    (tmp_path / "c.txt").write_bytes("中文".encode("gbk"))
    (tmp_path / "d.docx").write_bytes(b"not a zip")
    got = {r.path.rpartition("/")[2]: (r.page, r.text) for r in files.pages(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.csv": (1, "x | y, z\n1 | 2"), "b.html": (1, "hi there"), "c.txt": (1, "中文"), "d.docx": (0, None)}


def test_index_generations(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    assert index_store.current(spark, root) is None
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "chunk_id long, file string")
    index_store.publish(rows, root)
    with pytest.raises(ValueError):
        index_store.publish(rows.unionByName(rows), root)
    assert index_store.current(spark, root).count() == 2
    new = index_store.upserted(index_store.current(spark, root), spark.createDataFrame([(2, "c"), (3, "d")], "chunk_id long, file string"), "chunk_id")
    assert index_store.publish(new, root) == 2
    assert sorted(map(tuple, index_store.current(spark, root).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_breaker_and_bucket():
    b = S.Breaker(2, 10, 2)
    assert [b.step(t, ok) for t, ok in ((0, False), (1, False), (2, True), (12, True), (13, True), (14, False))] == ["closed", "open", "rejected", "half-open", "closed", "closed"]
    k = S.Bucket(0.1, 2)
    assert [k.step(t) for t in (0, 1, 2, 12)] == ["passed", "passed", "limited", "passed"]


def test_streams(spark, tmp_path):
    rows = [(f"2024-01-01 00:00:{i:02d}", i % 3, "error" if i % 2 else "view") for i in range(30)] + [("2024-01-01 03:00:00", 1, "view")]
    spark.createDataFrame(rows, "ts string, user_id int, event_type string").coalesce(1).write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, user_id int, event_type string").json(f"{tmp_path}/in")
    for name, df in {"rate": S.windowed_error_rate(stream, "10 seconds", "10 seconds", "1 minute"), "sessions": S.session_counts(stream, "user_id"), "once": S.once(stream, ["user_id"])}.items():
        q = df.writeStream.format("memory").queryName(f"t_{name}").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted((r.n, r.rate) for r in spark.table("t_rate").collect()) == [(10, 0.5)] * 3
    assert {(r.user_id, r.n) for r in spark.table("t_sessions").collect()} == {(0, 10), (1, 10), (2, 10)}
    assert spark.table("t_once").count() == 3


def test_best_of_each_takes_methods_first_and_fills_up(spark):
    rows = [("a", "x", 9), ("a", "y", 8), ("b", "x", 3), ("b", "z", 7), ("a", "w", 8)]
    df = spark.createDataFrame(rows, "method string, config string, score int")
    assert [tuple(r) for r in ranking.best_of_each(df, "method", "score", "config").collect()] == [("a", "x", 9), ("b", "z", 7)]
    assert [tuple(r) for r in ranking.best_of_each(df.where("method = 'a'"), "method", "score", "config").collect()] == [("a", "x", 9), ("a", "w", 8)]
    assert [r.config for r in ranking.best_of_each(df, "method", "score", "config", 4).collect()] == ["x", "z", "w", "y"]
    assert ranking.best_of_each(df.limit(0), "method", "score", "config").count() == 0
