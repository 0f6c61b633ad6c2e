"""Columns that registered queries derive from the given tables before the operator runs.

Each entry is (table, expressions); the expressions read alike in Spark and in ANSI SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

INPUTS = {
    # card-like numbers of 12 to 16 digits, plain and with separators
    "card_numbers": (
        "orders",
        (
            "o_orderkey",
            "CASE o_orderkey % 4 "
            "WHEN 0 THEN concat('4', lpad(cast(o_orderkey AS varchar(20)), 15, '0')) "
            "WHEN 1 THEN concat('5500 0000 ', lpad(cast(o_orderkey AS varchar(20)), 8, '0')) "
            "WHEN 2 THEN concat('3400-', lpad(cast(o_orderkey AS varchar(20)), 9, '0')) "
            "ELSE concat('60000', lpad(cast(o_orderkey AS varchar(20)), 7, '0')) END AS number",
        ),
    ),
    # identity-like numbers of 11, 12 and 13 digits, plain and with separators
    "identity_numbers": (
        "orders",
        (
            "o_orderkey",
            "CASE o_orderkey % 8 "
            "WHEN 0 THEN concat('2000 ', lpad(cast(o_orderkey AS varchar(20)), 8, '0')) "
            "WHEN 1 THEN cast(20000000000 + o_orderkey AS varchar(20)) "
            "WHEN 2 THEN cast(2000000000000 + o_orderkey AS varchar(20)) "
            "ELSE cast(200000000000 + o_orderkey * 7919 AS varchar(20)) END AS number",
        ),
    ),
    "tax_codes": (
        "orders",
        (
            "o_orderkey",
            "CASE o_orderkey % 5 "
            "WHEN 0 THEN concat('ABCDE', lpad(cast(o_orderkey % 10000 AS varchar(20)), 4, '0'), 'F') "
            "WHEN 1 THEN concat('ABCdE', lpad(cast(o_orderkey % 10000 AS varchar(20)), 4, '0'), 'F') "
            "WHEN 2 THEN concat('ABCDE', lpad(cast(o_orderkey AS varchar(20)), 5, '0'), 'F') "
            "WHEN 3 THEN concat('ABCD1', lpad(cast(o_orderkey % 10000 AS varchar(20)), 4, '0'), 'Z') "
            "ELSE concat('PQRST', lpad(cast(o_orderkey % 10000 AS varchar(20)), 4, '0'), 'z') END AS code",
        ),
    ),
    "names": (
        "customer",
        ("c_custkey", "substring(c_name, 1, cast(c_custkey % 19 AS int)) AS value"),
    ),
    # sizes from zero to beyond the largest unit
    "sizes": (
        "lineitem",
        (
            "l_orderkey",
            "l_linenumber",
            "cast(floor(l_extendedprice) AS bigint) * 100 AS price",
            "CASE l_linenumber % 7 WHEN 0 THEN 0 WHEN 1 THEN l_partkey "
            "WHEN 2 THEN cast(l_quantity AS bigint) * 1024 "
            "WHEN 3 THEN cast(l_quantity AS bigint) * 1048576 + l_partkey "
            "WHEN 4 THEN cast(l_quantity AS bigint) * 26843546 "
            "WHEN 5 THEN cast(l_quantity AS bigint) * 1099511627776 "
            "ELSE 1048576 - l_linenumber END AS size_bytes",
        ),
    ),
    "counts": ("lineitem", ("l_orderkey", "l_linenumber", "cast(l_quantity * (l_linenumber - 1) AS int) AS n")),
    "types": ("lineitem", ("l_orderkey", "cast(l_linenumber - 1 AS int) AS types")),
    # findings from elsewhere: keys repeat, some are unknown, some counts are zero
    "line_findings": (
        "lineitem",
        (
            "l_orderkey",
            "l_linenumber",
            "l_quantity",
            "l_extendedprice",
            "l_suppkey",
            "CASE l_partkey % 13 WHEN 0 THEN 'email' WHEN 1 THEN 'phone_in' WHEN 2 THEN 'pan' "
            "WHEN 3 THEN 'aadhaar' WHEN 4 THEN 'passport' WHEN 5 THEN 'credit_card' "
            "WHEN 6 THEN 'api_key' WHEN 7 THEN 'aws_access' WHEN 8 THEN 'aws_secret' "
            "WHEN 9 THEN 'jwt' WHEN 10 THEN 'password' WHEN 11 THEN 'db_conn' "
            "ELSE 'unknown_key' END AS key",
            "cast(l_quantity * (l_linenumber - 1) AS int) AS count",
            "CASE l_suppkey % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' "
            "WHEN 3 THEN 'UNSURE' ELSE NULL END AS confidence",
        ),
    ),
    "raw_scores": (
        "orders",
        (
            "o_orderkey",
            "cast(cast(o_orderkey % 2200 AS decimal(10,2)) / 20 AS decimal(10,2)) AS raw_score",
            "cast(o_orderkey % 3 AS int) AS types",
        ),
    ),
    "whole_scores": ("orders", ("o_orderkey", "cast(o_orderkey % 101 AS int) AS score")),
    "balances": ("customer", ("c_custkey", "cast(c_acctbal AS double) / 100 AS value")),
    # uploads of every kind and size
    "uploads": (
        "orders",
        (
            "o_orderkey",
            "concat('order.', cast(o_orderkey AS varchar(20)), "
            "CASE o_orderkey % 9 WHEN 0 THEN '.txt' WHEN 1 THEN '.CSV' WHEN 2 THEN '.pdf' "
            "WHEN 3 THEN '.Docx' WHEN 4 THEN '.exe' WHEN 5 THEN '.' WHEN 6 THEN '.tar.gz' "
            "WHEN 7 THEN '.txt.bak' ELSE '.txt' END) AS dotted",
            "CASE o_orderkey % 10 WHEN 0 THEN 'txt' WHEN 1 THEN 'README' ELSE '' END AS dotless",
            "CASE o_orderkey % 7 WHEN 0 THEN 0 WHEN 1 THEN 10485760 WHEN 2 THEN 10485761 "
            "WHEN 3 THEN 10485760 + o_orderkey * 1000 ELSE o_orderkey END AS size_bytes",
        ),
    ),
    # metadata of uploads, with names and sizes out of range
    "requests": (
        "orders",
        (
            "o_orderkey",
            "CASE o_orderkey % 6 WHEN 0 THEN '' "
            "ELSE repeat('n', cast(o_orderkey % 300 AS int)) END AS filename",
            "CASE o_orderkey % 5 WHEN 0 THEN 'text/plain' ELSE NULL END AS content_type",
            "CASE o_orderkey % 7 WHEN 0 THEN -1 WHEN 1 THEN 10485760 WHEN 2 THEN 10485761 "
            "ELSE o_orderkey END AS size_bytes",
        ),
    ),
    # reports as another program might hand them over
    "foreign_reports": (
        "orders",
        (
            "o_orderkey",
            "cast(o_orderkey % 111 AS int) - 5 AS score",
            "CASE o_orderkey % 6 WHEN 0 THEN 'low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'HIGH' "
            "WHEN 3 THEN 'critical' WHEN 4 THEN 'SEVERE' ELSE 'LOW' END AS risk_level",
            "cast(o_orderkey % 13 AS int) - 1 AS total_findings",
            "cast(o_orderkey AS int) AS total_characters",
            "cast(o_orderkey % 17 AS int) - 2 AS cooccurrence_bonus",
        ),
    ),
}

_ORDER_VALUES = {"card_numbers": ("number", "card"), "identity_numbers": ("number", "identity"), "tax_codes": ("code", "code"),
                 "raw_scores": ("raw_score", "raw_score"), "whole_scores": ("score", "score"), "uploads": ("size_bytes", "size_bytes")}


def _expression(name: str, column: str) -> str:
    return next(e for e in INPUTS[name][1] if e.endswith(f" AS {column}"))[: -len(f" AS {column}")]


# one value of each kind for every order
INPUTS["sql_values"] = (
    "orders",
    (
        "o_orderkey",
        *[f"{_expression(name, column)} AS {alias}" for name, (column, alias) in _ORDER_VALUES.items()],
        "CASE o_orderkey % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'aws_secret' WHEN 2 THEN 'phone_in' ELSE 'unknown_key' END AS key",
        "cast(o_orderkey % 120 AS int) AS n",
        "CASE o_orderkey % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' WHEN 3 THEN 'UNSURE' ELSE NULL END AS confidence",
        "cast(o_orderkey % 4 AS int) AS types",
    ),
)


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, expressions = INPUTS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*expressions)


def derive_sql(name: str) -> str:
    table, expressions = INPUTS[name]
    return f"SELECT {', '.join(expressions)} FROM {table}"
