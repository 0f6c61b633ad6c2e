"""The full report: one record per document."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dialect import BACKEND, Profile, resolve
from ..operators.advice import with_recommendations
from ..operators.columns import must_be_free, quoted, spare
from ..operators.risk import with_risk
from ..operators.scan import scan
from ..rules import RULES, Rule

_SCORES = ("score", "risk_level", "total_findings")
_TAIL = ("breakdown", "cooccurrence_bonus", "raw_score", "recommendations")


def assess(
    df: DataFrame,
    text: str = "text",
    keep: Sequence[str] | None = None,
    rules: Iterable[Rule] = RULES,
    profile: Profile | str = BACKEND,
) -> DataFrame:
    """Scan, score and advise: every result column beside the ``keep`` columns."""
    rules = tuple(rules)
    scanned = scan(df, text, keep, rules, profile)
    return with_recommendations(with_risk(scanned, rules, profile), rules, profile)


def report(
    df: DataFrame,
    text: str = "text",
    filename: str = "filename",
    size_bytes: str | None = None,
    keep: Sequence[str] = (),
    rules: Iterable[Rule] = RULES,
    profile: Profile | str = BACKEND,
) -> DataFrame:
    """The report record of each document.

    ``size_bytes`` names the column with the size of the original file; without
    one, the UTF-8 length of the text stands in. Findings leave out the rule key in
    the backend profile and keep it in the browser profile. Where the input has a
    ``status`` column, rows that are not ``ok`` come out with status ``error`` and null
    results: what was not read is not reported as clean.
    """
    profile = resolve(profile)
    must_be_free(keep, ("status", "filename", "size_bytes", "total_characters", "findings", *_SCORES, *_TAIL), "report")
    status_name, text_name = spare(keep, "status", "text")
    kept = quoted(keep)
    gated = "status" in df.columns
    status = F.when(F.col("status").eqNullSafe("ok"), "success").otherwise("error") if gated else F.lit("success")
    size = F.col(size_bytes) if size_bytes else F.octet_length(F.coalesce(F.col(text), F.lit("")))
    named = df.select(
        *kept,
        F.col(filename).alias("filename"),
        size.cast("bigint").alias("size_bytes"),
        F.col(text).alias(text_name),
        status.alias(status_name),
    )
    done = assess(named, text_name, [*keep, "filename", "size_bytes", status_name], rules, profile)
    fields = ["category", "label", "count", "severity", "confidence", "samples"]
    if profile.keep_finding_key:
        fields.insert(0, "key")
    shown = F.transform("findings", lambda f: F.struct(*[f[c].alias(c) for c in fields]))
    results = {c: F.col(c) for c in ("total_characters", *_SCORES)} | {"findings": shown} | {c: F.col(c) for c in _TAIL}
    if gated:
        results = {c: F.when(F.col(status_name) == "success", x) for c, x in results.items()}
    return done.select(
        *kept, F.col(status_name).alias("status"), "filename", "size_bytes", *[x.alias(c) for c, x in results.items()]
    )


def scan_log(reports: DataFrame) -> DataFrame:
    """The few figures of a report worth a log line."""
    return reports.select(
        "filename",
        "size_bytes",
        F.col("total_characters").alias("chars"),
        F.col("total_findings").alias("findings"),
        "score",
        "risk_level",
        "raw_score",
        "cooccurrence_bonus",
    )


def flat_report(assessed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Report figures without nested columns; null for documents that were not read."""
    made = ("total_characters", "total_findings", "types", "cooccurrence_bonus", "raw_score", "score", "risk_level", "n_recommendations")
    must_be_free(by, made, "flat_report")
    return assessed.select(
        *quoted(by),
        "total_characters",
        "total_findings",
        F.when(F.col("findings").isNotNull(), F.size("findings")).alias("types"),
        "cooccurrence_bonus",
        F.col("raw_score").cast("double").alias("raw_score"),
        "score",
        "risk_level",
        F.when(F.col("findings").isNotNull(), F.size("recommendations")).alias("n_recommendations"),
    )
