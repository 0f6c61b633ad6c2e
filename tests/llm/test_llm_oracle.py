"""Registered queries of this subpackage that SQL can express, against that SQL over whole tables."""

import os

import pytest

from compare import connect, duck_rows, duck_types, spark_rows
from leaksieve.llm import oracle_sql, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, name):
    con = connect(SF_DIR)
    df = queries()[name](spark, SF_DIR)
    columns, rows = spark_rows(df)
    want_columns, want_rows = duck_rows(con, oracle_sql()[name])
    assert columns == want_columns and dict(df.dtypes) == duck_types(con, oracle_sql()[name])
    assert rows == want_rows
    con.close()
