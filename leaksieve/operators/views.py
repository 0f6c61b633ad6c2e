"""Long views of scanned and scored documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strings import rule_label
from .columns import must_be_free, quoted, spare

_ENTRY = ("count", "confidence", "severity_weight", "confidence_factor", "volume_multiplier", "contribution")
_FINDING = ("key", "label", "category", "severity", "confidence", "count", "samples")


def findings_table(scanned: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per finding, numbered from 1 in report order. Clean and unread documents have none."""
    must_be_free(by, ("position", *_FINDING), "findings_table")
    of, (at, finding) = quoted(by), spare(by, "position", "finding")
    return scanned.select(*of, F.posexplode("findings").alias(at, finding)).select(
        *of, (F.col(at) + 1).alias("position"), f"{finding}.*"
    )


def sample_table(scanned: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per redacted sample, numbered from 1 in text order."""
    must_be_free(by, ("number", "sample"), "sample_table")
    of, at = quoted(by), spare(by, "position")[0]
    return findings_table(scanned, by).select(*of, "key", F.posexplode("samples").alias(at, "sample")).select(
        *of, "key", (F.col(at) + 1).alias("number"), "sample"
    )


def with_hits(scanned: DataFrame) -> DataFrame:
    """The documents in which something was found.

    Use before an ``_outer`` generator over a computed array: the plain generators
    make the optimizer compute that array twice, once to drop rows without entries.
    """
    return scanned.where(F.size("findings") > 0)


def breakdown_table(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per breakdown entry, greatest contribution first, with display label.

    Entries of equal contribution keep the order of the findings.
    """
    must_be_free(by, ("rank", "label", "key", *_ENTRY), "breakdown_table")
    of, (at, entry) = quoted(by), spare(by, "position", "entry")
    ranked = F.array_sort(
        F.transform(
            F.map_entries("breakdown"),
            lambda e, position: F.struct(
                (-e["value"]["contribution"]).alias("neg"),
                position.alias("position"),
                e["key"].alias("key"),
                e["value"].alias("entry"),
            ),
        )
    )
    return with_hits(scored).select(*of, F.posexplode_outer(ranked).alias(at, entry)).select(
        *of,
        (F.col(at) + 1).alias("rank"),
        F.col(f"{entry}.key").alias("key"),
        rule_label(F.col(f"{entry}.key")).alias("label"),
        f"{entry}.entry.*",
    )


def with_flags(scanned: DataFrame) -> DataFrame:
    """Add ``sensitive``: whether anything was found; null where the document was not read."""
    must_be_free(scanned.columns, ("sensitive",), "with_flags")
    return scanned.withColumn("sensitive", F.size("findings") > 0)
