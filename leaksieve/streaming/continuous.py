"""Continuous scan: documents in, reports appended, and on demand what needs state.

A document's result depends on that document alone, so the scan of a stream needs neither
watermark nor state store and runs in append mode with exactly the expressions of the
batch scan. State is kept only by ``once``, for deliveries seen, and by roll-ups.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.columns import quoted, spare
from ..plans.report import report


def read_stream(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    format: str = "parquet",
    files_per_batch: int = 1000,
    options: Mapping[str, object] | None = None,
) -> DataFrame:
    """A stream of the files arriving under a folder. File streams need their schema.

    A backlog is worked off in batches of ``files_per_batch``, so a lost batch is a
    bounded loss of work.
    """
    reader = spark.readStream.format(format).schema(schema)
    return reader.options(maxFilesPerTrigger=files_per_batch, **(options or {})).load(path)


def start_scan(
    results: DataFrame,
    path: str,
    checkpoint: str,
    format: str = "parquet",
    until_done: bool = False,
    every: str = "1 minute",
) -> StreamingQuery:
    """Append results of a streaming scan to a folder.

    ``checkpoint`` must lie on storage all executors share: a restarted query then
    goes on where it stopped and the sink holds each document once. ``until_done``
    works off what has arrived and stops; otherwise a batch starts ``every`` so often.
    """
    writer = (
        results.writeStream.outputMode("append")
        .format(format)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if until_done else writer.trigger(processingTime=every)
    return writer.start()


def once(arriving: DataFrame, by: Sequence[str], arrived: str, within: str, text: str = "text") -> DataFrame:
    """Drops rows that are delivered again: same ``by`` columns and same text.

    ``arrived`` is a timestamp column, ``within`` how far apart two deliveries may lie for the
    second to be dropped for sure. Spark holds a row's ``by`` columns and 128 bits of its text
    that long, not the text, and forgets them then; rows older than that count as too late.
    On a table that is no stream all repetitions go.
    """
    low, high = spare(arriving.columns, "low", "high")
    hashed = arriving.withColumns({low: F.xxhash64(text), high: F.xxhash64(F.lit(1), text)})
    keys = [*by, low, high]
    if not arriving.isStreaming:
        return hashed.dropDuplicates(keys).drop(low, high)
    return hashed.withWatermark(arrived, within).dropDuplicatesWithinWatermark(keys).drop(low, high)


def start_batches(
    results: DataFrame,
    path: str,
    checkpoint: str,
    partition_by: Sequence[str] = (),
    mode: str = "append",
    until_done: bool = False,
    every: str = "1 minute",
) -> StreamingQuery:
    """Writes each batch of a stream as Parquet into a folder of its own, ``path/batch=<id>``.

    A batch that is made again, after a failure, replaces its folder, so it adds no row. With
    ``partition_by`` one pass over a batch feeds several tables: records and errors of
    ``report_stream`` by ``status``. ``mode`` is ``append``, or ``update`` for roll-ups, whose
    groups come again in each batch that changes them; ``latest_groups`` reads those.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/batch={number}")

    writer = results.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if until_done else writer.trigger(processingTime=every)
    return writer.start()


def read_batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What ``start_batches`` wrote, of all batches."""
    return spark.read.schema(schema).parquet(path).select(*quoted(schema.names))


def latest_groups(spark: SparkSession, path: str, schema: StructType, by: Sequence[str]) -> DataFrame:
    """The state of a roll-up written in update mode: of each group the row of its latest batch."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(path)
    values = [c for c in schema.names if c not in by]
    last = F.max_by(F.struct(*quoted(values)), "batch")
    (name,) = spare(schema.names, "last")
    return rows.groupBy(*quoted(by)).agg(last.alias(name)).select(*quoted(by), f"{name}.*")


def report_stream(files: DataFrame, size_bytes: str = "size_bytes", **options) -> DataFrame:
    """Reports and errors of one stream of extracted files, each file decoded and scanned once.

    Report records, with ``http_code`` and ``detail`` besides; ``start_batches`` with
    ``partition_by=["status"]`` keeps the two kinds apart.
    """
    keep = [*options.pop("keep", ()), "http_code", "detail"]
    return report(files, size_bytes=size_bytes, keep=keep, **options)
