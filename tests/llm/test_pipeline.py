import os
import re

import corpus_pipeline
from sparkloom.llm import language_id, mixing
from sparkloom.llm.common import new_path
from tests.llm.test_near_dedup import brute_classes
from tests.llm.test_secret_scan import brute


def corpus():
    import random

    rng = random.Random(8)
    words = {"en": "the of and that with this have from which their would there about people".split(), "de": "der und nicht eine über straße für auch werden können schön heute morgen".split()}
    rows = []
    for i in range(160):
        lang = "en" if i % 3 else "de"
        text = " ".join(rng.choice(words[lang]) for _ in range(rng.randint(40, 90)))
        if i % 11 == 0:
            text += " password: hunter22x"
        rows.append((i, text, lang, "hot" if i % 2 else f"s{i % 5}", len(text)))
    rows += [(200 + i, rows[i][1] + (" extra" if i % 2 else ""), rows[i][2], "s9", 1) for i in range(12)]
    return rows + [(300, None, "en", None, None), (301, "12 %%", None, "s1", 5), (302, "", "en", "s1", 0)]


def test_stages_match_brute_force(spark):
    path = new_path(spark, "pipeline-test")
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        out.write.option("maxRecordsPerFile", 30 if name == "mixing" else 0).parquet(f"{path}/{name}")
        before, docs = docs, spark.read.parquet(f"{path}/{name}")
        seen.append((name, [tuple(r) for r in before.collect()], [r.asDict() for r in docs.collect()]))
        if k < 4:
            assert docs.columns == columns
    (_, raw, known), (_, _, single), (_, _, clean), (_, _, mixed), (_, _, packed) = seen
    rejected = {r.doc_id for r in language_id.classify(spark.read.parquet(f"{path}/documents.parquet")).where("rejected").collect()}
    assert {r["doc_id"] for r in known} == {r[0] for r in raw} - rejected and {300, 301, 302} <= rejected and len(rejected) < 8
    known.sort(key=lambda r: r["doc_id"])
    classes = brute_classes([r["doc_id"] for r in known], [r["text"] for r in known])
    assert sorted(r["doc_id"] for r in single) == sorted(set(classes.values())) and len(single) < len(known)
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in single} == {r["doc_id"] for r in mixed}
    originals = {r["doc_id"]: r["text"] for r in single}
    for r in clean:
        assert brute(r["text"]) == "" and r["n_chars"] == len(r["text"])
        assert r["text"] == re.sub(r"hunter22x", "[secret]", originals[r["doc_id"]])
    assert {(r["doc_id"], r["text"]) for r in mixed} == {(r["doc_id"], r["text"]) for r in clean}
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in mixed} and max(r["offset"] + r["length"] for r in packed) <= 2048
    # The mix is in the files and rows of its stage, and pieces of one length follow it.
    planned = [r.doc_id for r in mixing.schedule(spark.read.parquet(f"{path}/secret_scan")).orderBy("slot", "place").collect()]
    stored = [r.doc_id for r in spark.read.parquet(f"{path}/mixing").select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()]
    assert stored == planned and len(os.listdir(f"{path.removeprefix('file://')}/mixing")) > 8
    place, by_length = {x: i for i, x in enumerate(planned)}, {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        by_length.setdefault(r["length"], []).append(place[r["doc_id"]])
    assert max(map(len, by_length.values())) > 3 and all(x == sorted(x) for x in by_length.values())
    again = corpus_pipeline.run(spark, path)
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in again.collect()) == sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in packed)
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "secret_scan", "mixing", "packing"]


def test_empty_tables_repeated_rows_and_other_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    path = new_path(spark, "pipeline-cases")
    spark.createDataFrame([], schema).write.parquet(f"{path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{path}/none").count() == 0
    names = ["_text", "_key", "_slot", "_source", "slot", "place", "row", "key", "node", "low", "rank", "block", "weight"]
    rows = spark.createDataFrame(corpus() + corpus()[:9], schema).selectExpr("*", *(f"concat('v', doc_id) as `{n}`" for n in names))
    rows.write.parquet(f"{path}/more/documents.parquet")
    docs = spark.read.parquet(f"{path}/more/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, f"{path}/more").write.parquet(f"{path}/more/{name}")
        docs = spark.read.parquet(f"{path}/more/{name}")
        if k < 4:
            assert docs.columns == rows.columns
            kept = [r.asDict() for r in docs.collect()]
            assert kept and all(r[n] == f"v{r['doc_id']}" for r in kept for n in names)
        if k == 1:
            assert len({r["doc_id"] for r in kept}) == len(kept)
