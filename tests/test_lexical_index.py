import json
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.text import words
from sparkloom.operators import fulltext
from sparkloom.sources import lexical_index as L
from sparkloom.sources.store import Files

VOCABULARY = [f"w{i}" for i in range(60)]


def corpus(n=1500):
    rng = random.Random(9)
    out = []
    for i in range(n):
        words_ = rng.choices(VOCABULARY, [1 / (k + 1) for k in range(60)], k=rng.choice([3, 10, 40, 200]))
        out.append((i, " ".join(words_), f"s{i % 5}", "x"))
    return out + [(9001, None, "s1", "x"), (9002, "", "s1", "x"), (9003, "W1 w1, W1!", None, None), (9004, "w59 " * 500, "s0", "x")]


SCHEMA = "id long, text string, source string, key string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    return L.build(docs, f"file://{tmp_path_factory.mktemp('lexical')}/i", "id", "text", ["source"])


def ranked(df, k=None):
    rows = sorted(((-round(r.score, 9), r.id) for r in df.collect()))
    return rows if k is None else rows[:k]


@pytest.mark.parametrize("terms", [["w0"], ["w3", "w40"], ["w59", "w0", "w1"], ["w1", "w1"], ["nowhere", "w50"], ["nowhere"]])
def test_scores_and_best_equal_a_scan_of_the_texts(index, docs, terms):
    want = ranked(fulltext.search(docs, "id", "text", sorted(set(terms))))
    assert ranked(index.search(terms)) == want
    for k in (1, 10, 100):
        assert ranked(index.search(terms, k), k) == want[:k]


def test_filters(index, docs, spark):
    whole = {r.id: round(r.score, 9) for r in fulltext.search(docs, "id", "text", ["w2", "w7"]).collect()}
    sources = {r[0]: r[2] for r in corpus()}
    allowed = spark.range(0, 1200).withColumnRenamed("id", "id")
    want = sorted((-s, i) for i, s in whole.items() if sources[i] in ("s1", "s2") and i < 1200)
    for k in (None, 5, 400):
        got = ranked(index.search(["w2", "w7"], k, where=F.col("source").isin("s1", "s2"), allowed=allowed), k)
        assert got == want[:k]


def test_low_bounds_are_skipped_and_bounds_hold(index):
    weights = index.weights(["w59"])
    bounds = {r.segment: r.bound for r in index.bounds(weights).collect()}
    kept = index.promising(weights, 1)
    assert kept.count() < len(bounds)
    hits = index.postings.where("term = 'w59'").select("segment", F.explode("hits").alias("h")).select("segment", "h.*")
    share = index.share(F.col("tf"), F.col("length"))
    for r in hits.groupBy("segment").agg(F.max(share * weights["w59"]).alias("best")).collect():
        assert r.best <= bounds[r.segment] + 1e-12


def test_a_search_reads_its_terms_alone(index):
    plan = index.search(["w3", "w40"])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term, [w3,w40])" in plan or "PushedFilters: [IsNotNull(term), In(term" in plan or "In(term" in plan
    names = {c for c in index.postings.columns}
    assert names == {"term", "segment", "n", "most", "least", "hits"}
    header = index.bounds({"w3": 1.0})._jdf.queryExecution().toString()
    assert "hits" not in header[header.index("FileScan") :]


def test_segments_are_bounded_and_shared_by_terms(index):
    sizes = [r["count"] for r in index.documents.groupBy("segment").count().collect()]
    assert max(sizes) < 3 * L.BLOCK
    spread = index.documents.groupBy("segment").agg(F.max("length").alias("a"), F.min("length").alias("b")).collect()
    assert all(r.a + 1 < 2 * (r.b + 1) for r in spread)
    assert index.postings.groupBy("term", "segment").count().where("count > 1").isEmpty()


def test_long_documents_share_a_segment_with_fewer(spark, tmp_path, monkeypatch):
    """A segment is inverted in one task's arrays, so its words are bounded, not only its documents."""
    monkeypatch.setattr(L, "SEGMENT_WORDS", 2000, raising=False)
    docs = spark.createDataFrame([(i, f"w{i % 7} " * 500, "s", "x") for i in range(80)], SCHEMA)
    index = L.build(docs, f"file://{tmp_path}/i", "id")
    words_ = [r.n for r in index.documents.groupBy("segment").agg(F.sum("length").alias("n")).collect()]
    assert sum(words_) == 40_000 and max(words_) < 4 * 2000
    assert tuple(index.integrity().first()) == (0, 0, 0)
    assert ranked(index.search(["w3"])) == ranked(fulltext.search(docs, "id", "text", ["w3"]))


def test_postings_equal_those_of_a_plain_count(index, docs):
    got = index.postings.select("term", "segment", "n", "most", "least", F.explode("hits").alias("h")).select("term", "segment", "n", "most", "least", "h.*")
    each = docs.select("id", words(F.col("text")).alias("w")).select("id", F.size("w").alias("length"), F.explode("w").alias("term")).groupBy("id", "length", "term").agg(F.count("*").cast("int").alias("tf"))
    blocks = each.join(index.documents.select("id", "segment"), "id")
    heads = blocks.groupBy("term", "segment").agg(F.count("*").alias("n"), F.max("tf").alias("most"), F.min("length").alias("least"))
    want = blocks.join(heads, ["term", "segment"]).select("term", "segment", "n", "most", "least", F.col("id").alias("key"), "tf", "length")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_drift_and_rebuilding(spark, docs, tmp_path):
    root = f"file://{tmp_path}/i"
    index, anew = L.rebuilt(docs, root, "id")
    assert anew and index.number == 1 and tuple(index.integrity().first()) == (0, 0, 0)
    assert tuple(index.drift(docs).first()) == (0, 0, 0, 1504)
    little = docs.where("id <> 5").unionByName(docs.where("id = 6").withColumn("id", F.lit(7000).cast("long"))).withColumn("text", F.when(F.col("id") == 8, "else").otherwise(F.col("text")))
    assert tuple(index.drift(little).first()) == (1, 1, 1, 1504)
    index, anew = L.rebuilt(little, root, "id")
    assert not anew and index.number == 1
    index, anew = L.rebuilt(docs.where("id < 1300"), root, "id")
    assert anew and index.number == 2 and index.total == 1300
    assert L.opened(spark, root, 1).total == 1504  # readers of the older generation go on
    assert L.rebuilt(docs.where("id < 1300"), root, "id", force=True)[0].number == 3
    with pytest.raises(RuntimeError):
        L.build(docs, root, "id", expected=1)
    files = Files(spark, root)
    assert len([x for x in files.names(root) if x != "index"]) == 3  # what failed has left nothing


def test_a_damaged_index_is_seen(spark, docs, tmp_path):
    root = f"file://{tmp_path}/i"
    index = L.build(docs, root, "id")
    index.postings.where("term <> 'w1'").write.parquet(f"{index.folder}/other")
    entry = json.loads(Files(spark, root).text(L.commit_name(root, 1)))
    Files(spark, root).delete(f"{index.folder}/postings")
    spark.read.parquet(f"{index.folder}/other").write.parquet(f"{index.folder}/postings")
    whole = L.LexicalIndex(spark, root, 1).integrity().first()
    assert whole.wrong_length > 0 and whole.wrong_df == 1 and whole.unknown == 0 and entry["documents"] == 1504


def test_an_empty_table(spark, tmp_path):
    index = L.build(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/i", "id")
    assert index.total == 0 and index.search(["w1"], 5).count() == 0 and tuple(index.integrity().first()) == (0, 0, 0)


def test_the_index_of_a_table_is_built_once_for_each_state(spark, docs, tmp_path):
    path = f"file://{tmp_path}/t"
    docs.where("id < 20").write.parquet(path)
    first = L.of_table(spark, path, "t", "id")
    assert L.of_table(spark, path, "t", "id").folder == first.folder
    Files(spark, path).delete(f"{first.folder}/postings")
    again = L.of_table(spark, path, "t", "id")
    assert again.folder != first.folder and again.number == 2 and again.search(["w0"]).count() == first.documents.join(docs, "id").where("text LIKE '%w0 %' OR text LIKE '%w0'").count()
    docs.where("id < 30").write.mode("overwrite").parquet(path)
    other = L.of_table(spark, path, "t", "id")
    assert other.folder != first.folder and other.total == 30
    assert [r[0] for r in docs.where("id = 9003").select(F.size(words(F.col("text")))).collect()] == [3]


def test_phrases_match_a_search_for_substrings(spark, tmp_path):
    from sparkloom.functions import text as T

    rng = random.Random(11)
    pieces = ["東", "京", "会", "議", "東京", "会議", "の", " ", "a", "😀", "\n", "。"]
    data = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 90)))) for i in range(300)] + [(900, None), (901, "東" * 9), (902, "東京会議" * 30)]
    docs = spark.createDataFrame(data, "id long, text string")
    index = L.build(docs, f"file://{tmp_path}/i", "id", tokens=T.cjk_grams, places=True)
    phrases = ["東京会", "東京会議", "会議の", "東東東", "京会議東京", "議の東京会", "東京", "見たこと", "東東東東"]
    got = {(r.id, r.phrase): r.tf for r in index.phrases(phrases).collect()}
    want = {}
    for i, text in data:
        for p in phrases:
            n = sum((text or "").startswith(p, k) for k in range(len(text or "")))
            if n and len(p) > 2:
                want[i, p] = n
    assert got == want and index.phrases([]).count() == 0
    assert {r.id for r in index.phrase_search(["東京会議", "会議の"]).collect()} == {i for i, p in want if p in ("東京会議", "会議の")}
    assert tuple(index.integrity().first()) == (0, 0, 0)
    assert T.cjk_terms("about 东京会议 and 会") == ["东京会", "京会议"] and T.cjk_terms("words") == []
