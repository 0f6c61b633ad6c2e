"""Texts to scan, by name: columns of the given tables, and a derived corpus.

The derived corpus makes every rule fire at every volume tier. It is one expression
per column, written so that Spark and any ANSI SQL engine read it alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import spread, text_table

DERIVED_KEYS = (
    "c_custkey AS doc_id",
    "c_custkey AS k",
    "cast(c_custkey AS varchar(20)) AS s",
    "CASE (c_custkey + c_custkey % 13) % 5 "
    "WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 10 WHEN 3 THEN 50 ELSE 150 END AS n",
)

# piece j is present where the key is divisible by j
_PIECES = (
    (2, "concat('u', lpad(s,6,'0'), '@mail.example.com  ')"),
    (3, "concat('+91-9', lpad(s,9,'0'), '  ')"),
    (4, "concat('ABCDE', lpad(cast(k % 10000 AS varchar(20)),4,'0'), 'F  ')"),
    (5, "concat(cast(200000000000 + k AS varchar(20)), '  ')"),
    (6, "concat('A1', lpad(s,6,'0'), '  ')"),
    (7, "concat('4', lpad(s,15,'0'), '  ')"),
    (8, "concat('api_key = K', lpad(s,16,'0'), '  ')"),
    (9, "concat('AKIA', lpad(s,16,'0'), '  ')"),
    (10, "concat('aws_secret: ', lpad(s,40,'0'), '  ')"),
    (11, "concat('eyJ', lpad(s,6,'0'), '.eyJ', lpad(s,6,'0'), '.s', lpad(s,6,'0'), '  ')"),
    (12, "concat('pwd=', lpad(s,8,'0'), '  ')"),
    (13, "concat('postgres://u:p@h/', lpad(s,6,'0'), '  ')"),
)
DERIVED_TEXT = (
    "concat('note ', "
    + ", ".join(f"CASE WHEN k % {j} = 0 THEN repeat({piece}, n) ELSE '' END" for j, piece in _PIECES)
    + ", 'end')"
)

# Orders as texts: up to four different values of a kind in one document, parted by one
# space, a dash or a comma. A document is one row, so no customer's texts meet in a group.
ORDER_KEYS = (
    "o_orderkey AS doc_id",
    "o_orderkey AS k",
    "o_custkey AS c",
)


def _padded(number: str, width: int) -> str:
    return f"lpad(cast({number} AS varchar(20)), {width}, '0')"


_ORDER_PIECES = (
    (2, f"concat('a', {_padded('k', 6)}, '@mail.example.com b', {_padded('c', 6)}, '@mail.example.org,a', "
        f"{_padded('k', 6)}, '@mail.example.com c', {_padded('k + c', 6)}, '@x.example d', {_padded('c', 6)}, '@y.example ')"),
    (3, f"concat('+91-9', {_padded('k', 9)}, ' 91 8', {_padded('c', 9)}, ' 07', {_padded('k + c', 9)}, ' 6', "
        f"{_padded('k + 7', 9)}, ' ')"),
    (5, f"concat(cast(2000 + k % 8000 AS varchar(20)), ' ', {_padded('c % 10000', 4)}, ' ', {_padded('k % 10000', 4)}, ' x ', "
        f"cast(2000 + c % 8000 AS varchar(20)), '-', {_padded('k % 10000', 4)}, '-', {_padded('(k + c) % 10000', 4)}, ' ')"),
    (7, f"concat('4', {_padded('k % 1000', 3)}, '-', {_padded('c % 10000', 4)}, '-', {_padded('(k * 7) % 10000', 4)}, '-', "
        f"{_padded('k % 10000', 4)}, ' y 5500 0000 ', {_padded('k % 10000', 4)}, ' ', {_padded('c % 10000', 4)}, ' ')"),
    (11, f"concat('pwd=', {_padded('k', 8)}, ' password: ', {_padded('c', 8)}, ' token=', {_padded('k + c', 9)}, ' ')"),
)
ORDER_TEXT = (
    "concat('order ', "
    + ", ".join(f"CASE WHEN k % {j} = 0 THEN {piece} ELSE '' END" for j, piece in _ORDER_PIECES)
    + ", 'end')"
)

# name -> (table, kept key expressions, text expression)
COMPUTED = {
    "derived": ("customer", DERIVED_KEYS, DERIVED_TEXT),
    "orders": ("orders", ORDER_KEYS, ORDER_TEXT),
}

# name -> (table, text column, kept columns)
TABLES = {
    "documents": ("documents", "text", ("doc_id", "lang", "source")),
    "pages": ("pages", "html", ("page_id",)),
    "conversations": ("conversations", "text", ("conv_id", "turn", "role")),
    "benchmark": ("benchmark", "text", ("item_id",)),
}


def keys_of(name: str) -> tuple[str, ...]:
    return ("doc_id",) if name in COMPUTED else TABLES[name][2]


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The kept columns and ``text`` of a corpus."""
    if name in COMPUTED:
        table, keys, text = COMPUTED[name]
        # the keys are dealt out, not the texts made from them
        rows = spread(spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*keys), "auto")
        return rows.selectExpr("doc_id", f"{text} AS text")
    table, column, keep = TABLES[name]
    return text_table(spark, f"{sf_dir}/{table}.parquet", column, keep, partitions="auto")


def texts_sql(name: str) -> str:
    """The same corpus as SQL over the table views."""
    if name in COMPUTED:
        table, keys, text = COMPUTED[name]
        return f"SELECT doc_id, {text} AS text FROM (SELECT {', '.join(keys)} FROM {table}) t"
    table, column, keep = TABLES[name]
    return f"SELECT {', '.join(keep)}, {column} AS text FROM {table}"
