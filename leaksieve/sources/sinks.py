"""Writing results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .gates import report_checks


def as_json(df: DataFrame, keep: Sequence[str] = (), name: str = "report") -> DataFrame:
    """Each row as one JSON string, beside the ``keep`` columns."""
    return df.select(*keep, F.to_json(F.struct("*")).alias(name))


def write_reports(
    reports: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists",
    partition_by: Sequence[str] = (),
) -> None:
    """Write report records, one task per partition; ``risk_level`` makes a good partition."""
    reports.write.format(format).mode(mode).partitionBy(*partition_by).save(path)


def write_checked(
    reports: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists",
    partition_by: Sequence[str] = (),
) -> dict[str, int]:
    """Writes report records and checks them against the output contract in the same pass.

    Returns how many ``rows`` were written, how many break the contract (``broken``) and how
    many break each check. Spark counts them while it writes; nothing is read twice.
    """
    checks = report_checks(reports)
    holds = {name: F.coalesce(ok, F.lit(False)) for name, ok in checks.items()}
    counted = [F.count_if(~ok).alias(name) for name, ok in holds.items()]
    broken = F.count_if(~reduce(and_, holds.values())).alias("broken")
    seen = Observation()
    write_reports(reports.observe(seen, F.count(F.lit(1)).alias("rows"), broken, *counted), path, format, mode, partition_by)
    return seen.get


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder path every executor can reach.

    Lies under the folder the session names in ``spark.checkpoint.dir`` and is deleted
    when the session's JVM ends. Only in local mode, where driver and executors are one,
    may that be unset; a temporary folder is used then.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="leaksieve-")
    folder = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return folder
