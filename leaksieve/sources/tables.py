"""Texts that already sit in a table column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def spread(df: DataFrame, partitions: int | str | None = None) -> DataFrame:
    """Deal rows out evenly, one by one and not by key, so that no key can overload a task.

    ``None``, the default, leaves the input as it is. A number adds an exchange of whole
    rows into so many partitions, on a stream for each batch. ``auto`` is for small
    tables in one file: it adds that exchange, into twice as many partitions as there are
    cores, where the input has fewer splits than that, and leaves streams as they are. It
    counts splits, not row groups: a file of one row group may be split on paper while a
    single split holds all rows, so for files of few large row groups give a number.
    """
    if partitions is None or (df.isStreaming and partitions == "auto"):
        return df
    if partitions == "auto":
        wanted = 2 * df.sparkSession.sparkContext.defaultParallelism
        return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
    return df.repartition(int(partitions))


def text_table(
    spark: SparkSession,
    path: str,
    text: str = "text",
    keep: Sequence[str] = (),
    format: str = "parquet",
    partitions: int | str | None = None,
) -> DataFrame:
    """Read only the ``keep`` columns and the text (renamed ``text``) of a table.

    ``partitions`` is that of ``spread``; as it is by default, nothing is shuffled.
    """
    table = spark.read.format(format).load(path).select(*keep, F.col(text).alias("text"))
    return spread(table, partitions)

