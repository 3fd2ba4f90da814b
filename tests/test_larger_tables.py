"""Queries whose results depend on how many rows there are, on tables made for it."""

import pytest

from sparkloom.plans import QUERIES, SQL
from tests.compare import rows


def same(spark, folder, name, **tables):
    import duckdb

    duck = duckdb.connect()
    for table, df in tables.items():
        df.write.parquet(f"{folder}/{table}.parquet")
        duck.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(folder))
    result = duck.execute(SQL[name])
    got, want = rows(df.columns, df.collect()), rows([x[0] for x in result.description], result.fetchall())
    assert got == want and got[1]


@pytest.mark.parametrize("name, n", [("agg_minmax_unit", 210_000), ("agg_minmax_unit", 150_000), ("ext_scoping_strategy", 51_282)])
def test_many_documents(spark, tmp_path, name, n):
    same(spark, tmp_path, name, documents=spark.range(n).selectExpr("id AS doc_id", "concat('src', id % 7) AS source"))


def test_a_batch_is_handed_on_in_parts():
    import pandas as pd

    from sparkloom.plans import sequence_queries as S

    rows = pd.DataFrame({"i": range(50), "x": ["a" * 100_000] * 49 + [""]})
    parts = list(S.in_parts(rows, lambda i, x: [(i, k, x) for k in range(200 if i == 7 else 1)] if x else [], ["i", "k", "x"]))
    assert [tuple(r) for p in parts for r in p.itertuples(index=False)] == [(i, k, r) for i, r in enumerate(rows["x"]) for k in range(200 if i == 7 else 1) if r]
    assert len(parts) > 3 and max(p["x"].str.len().sum() for p in parts) <= S.HELD_CHARS + 100_000
    assert max(len(p) for p in S.in_parts(rows, lambda i, x: [(i, k, "") for k in range(1000)], ["i", "k", "x"])) == S.HELD_ROWS


@pytest.mark.parametrize("name", ["scan_docx", "scan_pptx_slides", "scan_xlsx_sheets"])
def test_short_rows_of_one_split_are_dealt_out(spark, tmp_path, name):
    spark.range(4000).coalesce(1).selectExpr("id AS c_custkey", "concat('Customer ', id) AS c_name", "'M' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and df.count() == 4000
