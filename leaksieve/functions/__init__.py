"""Scalar building blocks: plain Column in, Column out."""

from .checks import ascii_digits, luhn_valid, pan_valid, verhoeff_valid
from .scoring import (
    classify_tier,
    confidence_factor,
    contribution,
    cooccurrence_bonus,
    final_score,
    risk_level,
    severity_weight,
    volume_multiplier,
)
from .sql import register_functions
from .strings import file_extension, format_bytes, redact, rule_label, text_length

__all__ = [
    "ascii_digits", "classify_tier", "confidence_factor", "contribution", "cooccurrence_bonus",
    "file_extension", "final_score", "format_bytes", "luhn_valid", "pan_valid", "redact",
    "register_functions", "risk_level", "rule_label", "severity_weight", "text_length", "verhoeff_valid",
    "volume_multiplier",
]
