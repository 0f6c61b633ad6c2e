"""leaksieve: find personal data and secrets in texts, and score the risk, on Spark."""

from .dialect import BACKEND, BROWSER, PROFILES, Profile
from .functions import register_functions
from .operators import (
    documents_by_level,
    exposure_by,
    findings_table,
    mask,
    scan,
    score_findings,
    top_risky,
    with_recommendations,
    with_risk,
)
from .plans import assess, flat_report, report, scan_log
from .rules import RULES, Hint, Rule, only_rules, rule_catalog, rule_keys, with_rules
from .sources import extract_text, gate, quarantine, read_files, text_table, write_reports
from .streaming import read_stream, start_scan

__all__ = [
    "BACKEND", "BROWSER", "PROFILES", "RULES", "Hint", "Profile", "Rule", "assess",
    "documents_by_level", "exposure_by", "extract_text", "findings_table", "flat_report", "gate",
    "mask", "only_rules", "quarantine", "read_files", "read_stream", "register_functions", "report", "rule_catalog", "rule_keys",
    "scan", "scan_log", "score_findings", "start_scan", "text_table", "top_risky",
    "with_recommendations", "with_risk", "with_rules", "write_reports",
]
