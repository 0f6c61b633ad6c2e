"""The scalar functions for users of Spark SQL, as temporary SQL functions of a session.

Their bodies are SQL expressions, which the optimizer puts in the place of each call: they
cost what the columns cost, and no Python runs. Tests hold them equal to the columns.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .. import fixed_values as fv
from ..dialect import BACKEND, Profile, resolve
from .checks import _WIDE_DIGITS, _WIDE_VALUES, PAN_PATTERNS


def _text(value: str) -> str:
    return "r'" + value.replace("'", "\\'") + "'" if "\\" in value else "'" + value.replace("'", "''") + "'"


def _cases(key: str, table: dict, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {_text(k)} THEN {v}" for k, v in table.items()) + f" ELSE {default} END"


def _level(score: str) -> str:
    arms = " ".join(f"WHEN {score} <= {top} THEN {_text(name)}" for top, name in fv.LEVELS)
    return f"CASE WHEN {score} IS NULL THEN NULL {arms} ELSE {_text(fv.LEVEL_ABOVE)} END"


def _verhoeff(digits: str) -> str:
    flat = lambda table: _text("".join(str(d) for row in table for d in row))
    n = fv.AADHAAR_DIGITS
    digit = f"cast(substr({digits}, {n} - i, 1) AS int)"
    permuted = f"cast(substr({flat(fv.VERHOEFF_P)}, i % {len(fv.VERHOEFF_P)} * 10 + {digit} + 1, 1) AS int)"
    step = f"cast(substr({flat(fv.VERHOEFF_D)}, c * 10 + {permuted} + 1, 1) AS int)"
    return f"CASE WHEN length({digits}) = {n} THEN aggregate(sequence(0, {n - 1}), 0, (c, i) -> {step}) = 0 ELSE false END"


def _bytes(size: str) -> str:
    def scaled(power: int, suffix: str) -> str:
        unit = 1024**power
        tenths = f"(({size} * 20 + {unit}) div {2 * unit})"
        return f"concat({tenths} div 10, CASE WHEN {tenths} % 10 = 0 THEN '' ELSE concat('.', {tenths} % 10) END, ' {suffix}')"

    return (
        f"CASE WHEN {size} < 1024 THEN concat({size}, ' B') WHEN {size} < {1024**2} THEN {scaled(1, 'KB')} "
        f"WHEN {size} < {1024**3} THEN {scaled(2, 'MB')} ELSE {scaled(3, 'GB')} END"
    )


def _definitions(profile: Profile, prefix: str) -> dict[str, tuple[str, str, str]]:
    """Name: parameters, result type, body. Later ones may call earlier ones."""
    wide = f"translate(value, '{_WIDE_DIGITS}', '{_WIDE_VALUES}')" if profile.unicode else "value"
    digits = f"{prefix}ascii_digits(value)"
    short = fv.REDACT_SHORT
    tiers = " ".join(f"WHEN count BETWEEN {low} AND {high} THEN {factor}" for low, high, factor in fv.VOLUME_TIERS)
    factors = {k: v for k, v in fv.CONFIDENCE_FACTORS.items()}
    rounding = "bround" if profile.half_even else "round"
    tier = "floor(score)" if profile.truncate_tier else "score"
    return {
        "ascii_digits": ("value STRING", "STRING", f"regexp_replace({wide}, '[^0-9]', '')"),
        "luhn_valid": ("value STRING", "BOOLEAN", f"length({digits}) >= {fv.CARD_MIN_DIGITS} AND luhn_check({digits})"),
        "verhoeff_valid": ("value STRING", "BOOLEAN", _verhoeff(digits)),
        "pan_valid": ("value STRING", "BOOLEAN", f"value RLIKE {_text(PAN_PATTERNS[profile.unicode])}"),
        "redact": (
            "value STRING",
            "STRING",
            f"CASE WHEN length(value) <= {short} THEN concat(left(value, 1), repeat('*', length(value) - 1)) "
            "ELSE concat(left(value, 2), repeat('*', length(value) - 4), right(value, 2)) END",
        ),
        "format_bytes": ("size BIGINT", "STRING", _bytes("size")),
        "rule_label": ("key STRING", "STRING", "upper(replace(key, '_', ' '))"),
        "severity_weight": ("key STRING", "INT", _cases("key", fv.WEIGHTS, str(fv.DEFAULT_WEIGHT))),
        "confidence_factor": ("confidence STRING", "DECIMAL(2,1)", _cases("confidence", factors, fv.DEFAULT_FACTOR)),
        "volume_multiplier": ("count INT", "DECIMAL(2,1)", f"CASE {tiers} ELSE {fv.VOLUME_ABOVE} END"),
        "contribution": (
            "key STRING, count INT, confidence STRING",
            "DECIMAL(10,2)",
            f"cast({prefix}severity_weight(key) * {prefix}confidence_factor(confidence) * {prefix}volume_multiplier(count) AS DECIMAL(10,2))",
        ),
        "cooccurrence_bonus": (
            "types INT",
            "INT",
            f"CASE types WHEN 0 THEN {profile.clean_bonus} WHEN 1 THEN {fv.BONUS_ONE} WHEN 2 THEN {fv.BONUS_TWO} ELSE {fv.BONUS_MANY} END",
        ),
        "final_score": (
            "raw DECIMAL(18,2), bonus INT",
            "INT",
            f"cast(least({fv.MAX_SCORE}, {rounding}(cast(raw + bonus AS DECIMAL(38,2)), 0)) AS INT)",
        ),
        "risk_level": ("score INT", "STRING", _level("score")),
        "classify_tier": ("score DOUBLE", "STRING", _level(tier)),
    }


def register_functions(spark: SparkSession, profile: Profile | str = BACKEND, prefix: str = "leaksieve_") -> list[str]:
    """Makes the scalar functions known to SQL in this session; returns their names.

    They mean what the columns of the same names mean under the profile. A session can have
    both profiles under different prefixes; functions of the same name are replaced.
    """
    if not prefix.isidentifier():
        raise ValueError(f"a prefix must be the beginning of a name, not {prefix!r}")
    defined = _definitions(resolve(profile), prefix)
    for name, (parameters, result, body) in defined.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {result} RETURN {body}")
    return [prefix + name for name in defined]
