"""Every registered query against its SQL restatement."""

import os

import pytest

import __spark_entry__ as entry
from leaksieve.plans import oracle, queries as registered
from compare import connect, duck_rows, duck_types, spark_rows

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = registered.queries()
ORACLE = oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = connect(SF_DIR)
    yield con
    con.close()


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry(spark):
    result = entry.entry(spark)
    assert result.count() == 200 and result.columns[0] == "doc_id"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns, rows = spark_rows(df)
    want_columns, want_rows = duck_rows(duck, ORACLE[name])
    assert columns == want_columns
    assert dict(df.dtypes) == duck_types(duck, ORACLE[name])
    assert len(rows) == len(want_rows)
    assert rows == want_rows
