"""Reading texts and files, gating them, writing reports."""

from .files import decode_text, extract_text, read_files
from .folders import current, list_files, load_files, save_files, unseen, update
from .gates import gate, quarantine, request_violations, report_violations
from .sinks import as_json, shared_folder, write_checked, write_reports
from .tables import spread, text_table

__all__ = [
    "as_json", "current", "decode_text", "extract_text", "gate", "list_files", "load_files", "quarantine",
    "read_files", "report_violations", "request_violations", "save_files", "shared_folder", "spread",
    "text_table", "unseen", "update", "write_checked", "write_reports",
]
