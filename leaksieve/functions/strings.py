"""String scalars: redaction, labels, sizes and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..dialect import BACKEND, Profile, resolve


def redact(value: Column) -> Column:
    """A same-length preview: first character, or first and last two, around stars."""
    size = F.length(value)
    short = F.concat(F.left(value, F.lit(1)), F.repeat(F.lit("*"), size - 1))
    long = F.concat(
        F.left(value, F.lit(2)), F.repeat(F.lit("*"), size - 4), F.right(value, F.lit(2))
    )
    return F.when(size <= fv.REDACT_SHORT, short).otherwise(long)


def rule_label(key: Column) -> Column:
    """Display label of a rule key."""
    return F.upper(F.replace(key, F.lit("_"), F.lit(" ")))


def format_bytes(size: Column) -> Column:
    """A size in B, KB, MB or GB with at most one decimal; GB is the largest unit.

    Tenths are computed in whole numbers, half up, so no value depends on how a
    fraction is stored.
    """
    size = size.cast("bigint")

    def scaled(power: int, suffix: str) -> Column:
        unit = 1024**power
        tenths = F.call_function("div", size * 20 + unit, F.lit(2 * unit))
        whole = F.call_function("div", tenths, F.lit(10))
        decimal = F.when(tenths % 10 == 0, "").otherwise(F.concat(F.lit("."), tenths % 10))
        return F.concat(whole, decimal, F.lit(f" {suffix}"))

    return (
        F.when(size < 1024, F.concat(size, F.lit(" B")))
        .when(size < 1024**2, scaled(1, "KB"))
        .when(size < 1024**3, scaled(2, "MB"))
        .otherwise(scaled(3, "GB"))
    )


def file_extension(filename: Column, profile: Profile | str = BACKEND) -> Column:
    """The part after the last dot, lower case.

    Without a dot the backend profile gives an empty extension, the browser
    profile the whole name.
    """
    after_dot = F.lower(F.substring_index(filename, ".", -1))
    if not resolve(profile).dotless_extension:
        return F.when(F.contains(filename, F.lit(".")), after_dot).otherwise("")
    return after_dot


def text_length(text: Column, profile: Profile | str = BACKEND) -> Column:
    """Number of code points (backend) or of UTF-16 units (browser)."""
    if resolve(profile).utf16_length:
        return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")
    return F.length(text)
