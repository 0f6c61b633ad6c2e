"""Scoring scalars. All arithmetic is exact decimal, so sums do not depend on order."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..dialect import BACKEND, Profile, resolve
from .constants import lookup


def severity_weight(key: Column, weights: dict | None = None, default: int = fv.DEFAULT_WEIGHT) -> Column:
    """Base points of a rule key."""
    return F.coalesce(lookup(weights or fv.WEIGHTS, key, "int"), F.lit(default))


def confidence_factor(confidence: Column) -> Column:
    """Factor of a confidence; an unknown or absent one counts as MEDIUM."""
    factor = lookup(fv.CONFIDENCE_FACTORS, confidence, "decimal(2,1)")
    return F.coalesce(factor, F.lit(Decimal(fv.DEFAULT_FACTOR)))


def volume_multiplier(count: Column) -> Column:
    """Multiplier of a match count, by tier."""
    out = F
    for low, high, factor in fv.VOLUME_TIERS:
        out = out.when(count.between(low, high), F.lit(Decimal(factor)))
    return out.otherwise(F.lit(Decimal(fv.VOLUME_ABOVE)))


def points(weight: Column, factor: Column, volume: Column) -> Column:
    """Weight x confidence factor x volume multiplier, to the cent."""
    return (weight * factor * volume).cast("decimal(10,2)")


def contribution(key: Column, count: Column, confidence: Column, weights: dict | None = None) -> Column:
    """Points one finding adds to the raw score."""
    return points(severity_weight(key, weights), confidence_factor(confidence), volume_multiplier(count))


def cooccurrence_bonus(types: Column, profile: Profile | str = BACKEND) -> Column:
    """Bonus for the number of active data types.

    In the backend profile a document with no findings gets the bonus for "three
    or more", hence a score of 12; the browser profile gives it nothing.
    """
    return (
        F.when(types == 0, resolve(profile).clean_bonus)
        .when(types == 1, fv.BONUS_ONE)
        .when(types == 2, fv.BONUS_TWO)
        .otherwise(fv.BONUS_MANY)
    )


def final_score(raw: Column, bonus: Column, profile: Profile | str = BACKEND) -> Column:
    """Whole points, at most 100: half to even (backend) or half up (browser)."""
    rounding = F.bround if resolve(profile).half_even else F.round
    total = (raw + bonus).cast("decimal(38,2)")
    return F.least(F.lit(fv.MAX_SCORE), rounding(total, 0)).cast("int")


def risk_level(score: Column) -> Column:
    """LOW, MEDIUM, HIGH or CRITICAL; null for a null score."""
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for top, level in fv.LEVELS:
        out = out.when(score <= top, level)
    return out.otherwise(fv.LEVEL_ABOVE)


def classify_tier(score: Column, profile: Profile | str = BACKEND) -> Column:
    """Level of a fractional score; the backend profile drops the fraction first."""
    if resolve(profile).truncate_tier:
        score = F.floor(score)  # below zero every value is LOW either way
    return risk_level(score)
