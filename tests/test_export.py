import pytest
from pyspark.sql import functions as F

from sparkloom.plans import strategies
from sparkloom.sources import export


def test_groups_come_back_whole_and_in_order(spark, tmp_path):
    rows = [(i, f"s{i % 3}" if i % 7 else None, f"line one of {i}\nline two\r\n" * (i % 4)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, source string, text string").repartition(5)
    back = export.written(df, f"file://{tmp_path}/out", ["source"], ["id"], F.concat(F.col("id"), F.lit(":"), "text"))
    got = sorted((r.source or "", r.value) for r in back.collect())
    assert got == sorted((s or "", f"{i}:{t}") for i, s, t in rows)
    folder = tmp_path / "out" / "source=s1"
    parts = [x for f in sorted(folder.glob("part-*")) for x in f.read_text(newline="").split("\0")[:-1]]
    assert [int(x.split(":")[0]) for x in parts] == [i for i, s, _ in rows if s == "s1"]


def test_an_empty_table_is_an_empty_export(spark, tmp_path):
    df = spark.createDataFrame([], "id long, source string, text string")
    assert export.written(df, f"file://{tmp_path}/out", ["source"], ["id"], F.col("text")).count() == 0


def test_strategies_fall_back():
    have = {"hybrid": lambda: 1, "vector": lambda: 2}
    assert strategies.selected("vector", have)() == 2 and strategies.selected("multimodal", have)() == 1
    assert strategies.selected("hybrid", {"vector": lambda: 2})() == 2
    with pytest.raises(ValueError):
        strategies.selected("hybrid", {})
