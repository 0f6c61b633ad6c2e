"""Recommendations: what to do about the data types found in a document."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dialect import BACKEND, Profile, resolve
from ..functions.constants import constant, lookup
from ..rules import RULES, Rule, weights_of
from .columns import must_be_free, quoted, spare
from .views import with_hits


def recommendations(
    findings: Column, rules: Iterable[Rule] = RULES, profile: Profile | str = BACKEND
) -> Column:
    """Advice texts, heaviest data type first, then the two general ones.

    A rule's own text goes before the profile's. Ties keep the order of the findings, keys without a text are passed over and
    a document without findings gets an empty list, one that was not read (null) none.
    """
    profile, rules = resolve(profile), tuple(rules)
    weights = weights_of(rules)
    advice = {r.key: r.advice_in(profile) for r in rules}
    advice = {**profile.advice, **{k: text for k, text in advice.items() if text}}
    ordered = F.array_sort(
        F.transform(
            findings,
            lambda f, position: F.struct(
                (-F.coalesce(lookup(weights, f["key"], "int"), F.lit(0))).alias("neg_weight"),
                position.alias("position"),
                f["key"].alias("key"),
            ),
        )
    )
    keys = F.array_distinct(F.transform(ordered, lambda f: f["key"]))
    texts = F.filter(F.transform(keys, lambda k: lookup(advice, k, "string")), F.isnotnull)
    always = constant(list(profile.advice_always), "array<string>")
    return F.when(F.size(findings) > 0, F.concat(texts, always)).when(
        findings.isNotNull(), F.array().cast("array<string>")
    )


def with_recommendations(
    scanned: DataFrame, rules: Iterable[Rule] = RULES, profile: Profile | str = BACKEND
) -> DataFrame:
    must_be_free(scanned.columns, ("recommendations",), "with_recommendations")
    return scanned.withColumn(
        "recommendations", recommendations(F.col("findings"), rules, profile)
    )


def numbered_recommendations(advised: DataFrame, by: Iterable[str]) -> DataFrame:
    """One row per recommendation, numbered from 1."""
    by = list(by)
    must_be_free(by, ("number", "recommendation"), "numbered_recommendations")
    at, of = spare(by, "position")[0], quoted(by)
    return with_hits(advised).select(*of, F.posexplode_outer("recommendations").alias(at, "recommendation")).select(
        *of, (F.col(at) + 1).alias("number"), "recommendation"
    )
