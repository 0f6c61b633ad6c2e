"""Operators: DataFrame in, DataFrame out."""

from .advice import numbered_recommendations, recommendations, with_recommendations
from .masking import mask
from .risk import breakdown_of, legacy_score, score_findings, with_risk
from .rollups import (
    distinct_values,
    documents_by_level,
    exposure_by,
    exposure_cube,
    merge_values,
    top_risky,
    top_risky_by,
    value_hashes,
)
from .scan import matches, scan
from .views import breakdown_table, findings_table, sample_table, with_flags

__all__ = [
    "breakdown_of", "breakdown_table", "distinct_values", "documents_by_level", "exposure_by", "exposure_cube",
    "findings_table", "legacy_score", "mask", "matches", "merge_values", "numbered_recommendations",
    "recommendations", "sample_table", "scan", "score_findings", "top_risky", "top_risky_by", "value_hashes",
    "with_flags", "with_recommendations", "with_risk",
]
