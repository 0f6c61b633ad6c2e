"""Checksum and structure validators for matched values."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..dialect import BACKEND, Profile, resolve
from .constants import constant

# Every non-ASCII decimal digit and its ASCII value, from the Unicode database.
_WIDE_DIGITS = "".join(
    chr(c) for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"
)
_WIDE_VALUES = "".join(str(unicodedata.decimal(c)) for c in _WIDE_DIGITS)


def ascii_digits(value: Column, profile: Profile | str = BACKEND) -> Column:
    """The digits of a value, everything else removed.

    The backend profile counts any Unicode decimal digit, so those are folded to
    ASCII first; the lookup runs only for values that hold a non-ASCII character.
    """
    if resolve(profile).unicode:
        value = F.when(
            value.rlike(r"[^\x00-\x7f]"), F.translate(value, _WIDE_DIGITS, _WIDE_VALUES)
        ).otherwise(value)
    return F.regexp_replace(value, "[^0-9]", "")


def _digits_satisfy(value: Column, profile: Profile | str, holds) -> Column:
    # a one-element array binds the digits once, however often ``holds`` uses them
    return F.exists(F.array(ascii_digits(value, profile)), holds)


def luhn_valid(value: Column, profile: Profile | str = BACKEND) -> Column:
    """True for at least 13 digits (separators ignored) whose Luhn sum is a multiple of ten."""
    return _digits_satisfy(
        value,
        profile,
        lambda digits: (F.length(digits) >= fv.CARD_MIN_DIGITS)
        & F.call_function("luhn_check", digits),
    )


def verhoeff_valid(value: Column, profile: Profile | str = BACKEND) -> Column:
    """True for exactly 12 digits (separators ignored) with a zero Verhoeff checksum."""
    mult = constant([digit for row in fv.VERHOEFF_D for digit in row], "array<int>")
    perm = constant([digit for row in fv.VERHOEFF_P for digit in row], "array<int>")

    def holds(digits: Column) -> Column:
        def fold(check: Column, position: Column) -> Column:
            digit = F.substr(digits, F.lit(fv.AADHAAR_DIGITS) - position, F.lit(1)).cast("int")
            permuted = F.get(perm, (position % len(fv.VERHOEFF_P)) * 10 + digit)
            return F.get(mult, check * 10 + permuted)

        positions = F.sequence(F.lit(0), F.lit(fv.AADHAAR_DIGITS - 1))
        return F.when(
            F.length(digits) == fv.AADHAAR_DIGITS, F.aggregate(positions, F.lit(0), fold) == 0
        ).otherwise(False)

    return _digits_satisfy(value, profile, holds)


_CAPITAL = r"[\p{L}&&\p{IsUppercase}]"
_FIRST_FIVE = r"(?=.{0,4}\p{IsUppercase})[\p{L}&&[^\p{IsLowercase}\p{Lt}]]{5}"
#: By whether letters and digits of any alphabet count.
PAN_PATTERNS = {True: rf"^{_FIRST_FIVE}\p{{Nd}}{{4}}{_CAPITAL}\z", False: r"^[A-Z]{5}[0-9]{4}[A-Z]\z"}


def pan_valid(value: Column, profile: Profile | str = BACKEND) -> Column:
    """True for five capital letters, four digits and one capital letter, and nothing else.

    The backend profile takes any alphabet: the first five must be letters, at
    least one of them a capital and none of them lower or title case.
    """
    return value.rlike(PAN_PATTERNS[resolve(profile).unicode])
