import json
import threading

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import generations as G
from sparkloom.sources.store import Files

SCHEMA = "chunk long, file string, value int"


def rows(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def seen(spark, root, at=None):
    return sorted(((r.chunk, r.file, r.value) for r in G.read(spark, root, at).collect()), key=str)


@pytest.fixture()
def root(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    assert G.read(spark, root) is None and G.version(spark, root) == 0
    assert G.write(rows(spark, (1, "a", 1), (2, "a", 1), (3, "b", 1), (4, None, 1)), root, ["file"], "chunk", base=True) == 1
    return root


def folders(spark, root):
    return [Files(spark, root).names(f"{root}/{x}") for x in ("data", "actions", "journal")]


def test_files_are_replaced_and_removed_as_wholes(spark, root):
    assert G.write(rows(spark, (2, "a", 2), (9, "a", 2), (4, None, 2)), root, ["file"], "chunk") == 2
    assert seen(spark, root) == sorted([(2, "a", 2), (9, "a", 2), (3, "b", 1), (4, None, 2)], key=str)
    assert G.write(rows(spark), root, ["file"], "chunk", removed=spark.createDataFrame([("b",), (None,)], "file string")) == 3
    assert seen(spark, root) == [(2, "a", 2), (9, "a", 2)]
    assert seen(spark, root, 1) == sorted([(1, "a", 1), (2, "a", 1), (3, "b", 1), (4, None, 1)], key=str)  # older readers see their number
    assert [(r.file, r.rows, r.number) for r in G.live(spark, root).collect()] == [("a", 2, 2)]
    assert G.write(rows(spark, (3, "b", 4)), root, ["file"], "chunk") == 4
    assert seen(spark, root) == [(2, "a", 2), (3, "b", 4), (9, "a", 2)]


@pytest.mark.parametrize("fault", ["duplicate", "null", "ids", "fingerprint", "rows", "source", "commit"])
def test_a_failed_write_leaves_everything_as_it_was(spark, root, fault, monkeypatch):
    before, old = folders(spark, root), seen(spark, root)
    new, more, kind = rows(spark, (7, "a", 5)), {}, ValueError
    if fault == "duplicate":
        new = rows(spark, (7, "a", 5), (7, "b", 5))
    elif fault == "null":
        new = rows(spark, (None, "a", 5))
    elif fault == "ids":
        more = {"ids": spark.createDataFrame([(7,), (8,)], "chunk long")}
    elif fault == "fingerprint":
        new, more = new.withColumn("fingerprint", F.lit("old")), {"fingerprint": "new"}
    elif fault == "rows":
        new, kind = new.withColumn("value", F.raise_error(F.lit("embedding failed")).cast("int")), Exception
    elif fault == "source":
        more, kind = {"unchanged": lambda: False}, G.Conflict
    else:
        def fails(*_):
            raise RuntimeError("commit fault")

        monkeypatch.setattr(Files, "put_new", fails)
        kind = RuntimeError
    with pytest.raises(kind):
        G.write(new, root, ["file"], "chunk", **more)
    assert folders(spark, root) == before and seen(spark, root) == old and G.version(spark, root) == 1


def test_of_two_publishers_one_fails(spark, root):
    assert G.write(rows(spark, (1, "x", 2)), root, ["file"], "chunk", base=True, expected=1) == 2
    with pytest.raises(G.Conflict):
        G.write(rows(spark, (1, "y", 3)), root, ["file"], "chunk", base=True, expected=1)
    assert seen(spark, root) == [(1, "x", 2)]


def test_at_the_same_time(spark, root):
    results = []

    def publish(k):
        try:
            results.append(G.write(rows(spark, (k, "z", k)), root, ["file"], "chunk", base=True, expected=1))
        except G.Conflict:
            results.append(None)

    threads = [threading.Thread(target=publish, args=(k,)) for k in range(4)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert sorted(map(str, results)) == ["2", "None", "None", "None"] and len(seen(spark, root)) == 1
    assert folders(spark, root)[2] == []


def test_writers_of_other_files_follow_one_another(spark, root):
    assert G.write(rows(spark, (5, "a", 2)), root, ["file"], "chunk", expected=1) == 2
    assert G.write(rows(spark, (6, "b", 2)), root, ["file"], "chunk", expected=1) == 3
    with pytest.raises(G.Conflict):
        G.write(rows(spark, (7, "a", 3)), root, ["file"], "chunk", expected=1)
    assert seen(spark, root) == sorted([(5, "a", 2), (6, "b", 2), (4, None, 1)], key=str)


@pytest.mark.parametrize("committed", [False, True])
def test_a_killed_writer_is_recovered(spark, root, committed, monkeypatch):
    if committed:  # killed between the commit and the end of its journal entry
        G.write(rows(spark, (7, "a", 5)), root, ["file"], "chunk")
        generation = [r.generation for r in G.live(spark, root).where("file = 'a'").collect()][0]
    else:
        monkeypatch.setattr(G, "taken_back", lambda *_: None)
        with pytest.raises(G.Conflict):
            G.write(rows(spark, (7, "a", 5)), root, ["file"], "chunk", unchanged=lambda: False)
        monkeypatch.undo()
        generation = Files(spark, root).names(f"{root}/journal")[0][:-5]
    Files(spark, root).put(f"{root}/journal/{generation}.json", json.dumps({"generation": generation, "began": 0}))
    assert (7, "a", 5) in seen(spark, root) if committed else (1, "a", 1) in seen(spark, root)
    assert G.recover(spark, root) == {generation: committed} and G.recover(spark, root) == {}
    assert f"generation={generation}" in Files(spark, root).names(f"{root}/data") if committed else f"generation={generation}" not in Files(spark, root).names(f"{root}/data")
    assert len(seen(spark, root)) == (3 if committed else 4)


def test_a_writer_under_way_is_left_alone(spark, root):
    import time

    Files(spark, root).put(f"{root}/journal/gx.json", json.dumps({"generation": "gx", "began": time.time()}))
    assert G.recover(spark, root) == {} and folders(spark, root)[2] == ["gx.json"]


def test_compact_and_vacuum(spark, root):
    G.write(rows(spark, (9, "a", 2)), root, ["file"], "chunk")
    whole = seen(spark, root)
    assert G.compact(spark, root, ["file"], "chunk") == 3 and seen(spark, root) == whole
    assert len(G.vacuum(spark, root, 3)) == 2 and seen(spark, root) == whole
    assert len(folders(spark, root)[0]) == 1


def test_snapshot_knows_rows_not_their_order(spark):
    a = rows(spark, (1, "a", 1), (2, "b", None))
    assert G.snapshot(a) == G.snapshot(a.orderBy(F.desc("chunk"))) != G.snapshot(rows(spark, (1, "a", 1), (2, "b", 0)))
