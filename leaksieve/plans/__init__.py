"""Whole plans made of operators."""

from .report import assess, flat_report, report, scan_log

__all__ = ["assess", "flat_report", "report", "scan_log"]
