"""Scoring: per document on the findings array, or on a long findings table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dialect import BACKEND, Profile, resolve
from ..functions.scoring import (
    confidence_factor,
    contribution,
    cooccurrence_bonus,
    final_score,
    points,
    risk_level,
    severity_weight,
    volume_multiplier,
)
from ..rules import RULES, Rule, weights_of
from .columns import must_be_free, quoted, spare

_ZERO = "0.00"
_MADE = ("breakdown", "total_findings", "raw_score", "cooccurrence_bonus", "score", "risk_level")


def breakdown_entry(key: Column, count: Column, confidence: Column, weights: dict) -> Column:
    """How one finding's contribution comes about."""
    weight, factor = severity_weight(key, weights), confidence_factor(confidence)
    volume = volume_multiplier(count)
    return F.struct(
        count.cast("int").alias("count"),
        confidence.alias("confidence"),
        weight.alias("severity_weight"),
        factor.alias("confidence_factor"),
        volume.alias("volume_multiplier"),
        points(weight, factor, volume).alias("contribution"),
    )


def with_risk(
    scanned: DataFrame, rules: Iterable[Rule] = RULES, profile: Profile | str = BACKEND
) -> DataFrame:
    """Add ``total_findings, breakdown, raw_score, cooccurrence_bonus, score, risk_level``.

    Works on the ``findings`` array of each row, which holds at most one entry per
    rule, so it needs no shuffle. The score does not go by way of the breakdown, which
    is therefore only built where it is used. Rows whose findings are null, since they were
    not read, get null results. Columns of these names must not be there yet.
    """
    must_be_free(scanned.columns, _MADE, "with_risk")
    profile, weights = resolve(profile), weights_of(rules)
    entries = F.transform(
        "findings",
        lambda f: F.struct(
            f["key"].alias("key"),
            breakdown_entry(f["key"], f["count"], f["confidence"], weights).alias("value"),
        ),
    )
    raw = F.aggregate(
        "findings",
        F.lit(_ZERO).cast("decimal(18,2)"),
        lambda total, f: (total + contribution(f["key"], f["count"], f["confidence"], weights)).cast("decimal(18,2)"),
    )
    total = F.aggregate("findings", F.lit(0), lambda n, f: n + f["count"])
    was_read = F.col("findings").isNotNull()
    bonus = F.when(was_read, cooccurrence_bonus(F.size("findings"), profile))
    score = final_score(F.col("raw_score"), F.col("cooccurrence_bonus"), profile)
    return (
        scanned.withColumn("breakdown", F.map_from_entries(entries))
        .withColumns({"total_findings": total, "raw_score": raw, "cooccurrence_bonus": bonus})
        .withColumn("score", F.when(was_read, score))
        .withColumn("risk_level", risk_level(F.col("score")))
    )


def score_findings(
    findings: DataFrame,
    by: Sequence[str],
    key: str = "key",
    count: str = "count",
    confidence: str = "confidence",
    rules: Iterable[Rule] = RULES,
    profile: Profile | str = BACKEND,
) -> DataFrame:
    """Score findings that come as rows: one output row per ``by`` group.

    Takes findings from anywhere: unknown keys weigh 10, a missing confidence
    counts as MEDIUM, zero counts add nothing. A repeated key contributes and
    counts as an active type each time. Sums are combined before the shuffle, so
    a group holding most of the rows costs no more than any other.
    """
    profile, weights = resolve(profile), weights_of(rules)
    n = F.coalesce(F.col(count), F.lit(0))
    active = n != 0
    added = F.when(active, contribution(F.col(key), n, F.col(confidence), weights))
    return (
        findings.groupBy(*by)
        .agg(
            F.coalesce(F.sum(added), F.lit(_ZERO)).cast("decimal(18,2)").alias("raw_score"),
            F.count_if(active).cast("int").alias("active_types"),
            F.sum(n).alias("total_findings"),
        )
        .withColumn("cooccurrence_bonus", cooccurrence_bonus(F.col("active_types"), profile))
        .withColumn("score", final_score(F.col("raw_score"), F.col("cooccurrence_bonus"), profile))
        .withColumn("risk_level", risk_level(F.col("score")))
    )


def legacy_score(scored: DataFrame) -> DataFrame:
    """The score as a plain double, other columns kept."""
    return scored.withColumn("score", F.col("score").cast("double"))


def breakdown_of(
    findings: DataFrame,
    by: Sequence[str],
    key: str = "key",
    count: str = "count",
    confidence: str = "confidence",
    last_by: str | None = None,
    rules: Iterable[Rule] = RULES,
) -> DataFrame:
    """Breakdown entries of findings that come as rows: one row per group and key.

    Where a key repeats within a group, the entry with the greatest ``last_by``
    stands; name that column only if keys can repeat, since it costs a shuffle. It must
    order the entries of a key totally: of ties, any may stand. Without it, a repeated
    key keeps all its rows.
    """
    made = ("key", "count", "confidence", "severity_weight", "confidence_factor", "volume_multiplier", "contribution")
    must_be_free(by, made, "breakdown_of")
    active = findings.where(F.coalesce(F.col(count), F.lit(0)) != 0)
    latest_name, entry_name = spare([*by, key, count, confidence], "latest", "entry")
    of, key_name = quoted(by), quoted([key])[0]
    if last_by is not None:
        latest = F.max_by(F.struct(F.col(count).alias("count"), F.col(confidence).alias("confidence")), F.col(last_by))
        active = active.groupBy(*of, key_name).agg(latest.alias(latest_name))
        count, confidence = f"{latest_name}.count", f"{latest_name}.confidence"
    entry = breakdown_entry(F.col(key_name), F.col(count), F.col(confidence), weights_of(rules))
    return active.select(*of, F.col(key_name).alias("key"), entry.alias(entry_name)).select(*of, "key", f"{entry_name}.*")
