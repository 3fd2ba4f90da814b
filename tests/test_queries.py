"""Every query against its SQL on the smallest tables."""

import pytest

from sparkloom.plans import QUERIES, SQL
from tests.compare import DATA, connection, rows


@pytest.fixture(scope="module")
def duck():
    return connection()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = rows(df.columns, df.collect())
    result = duck.execute(SQL[name])
    want = rows([x[0] for x in result.description], result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    df.write.format("noop").mode("overwrite").save()  # every row and column is computed
    assert df.columns
