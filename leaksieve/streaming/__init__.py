"""The same scan on arriving documents."""

from .continuous import latest_groups, once, read_batches, read_stream, report_stream, start_batches, start_scan

__all__ = ["latest_groups", "once", "read_batches", "read_stream", "report_stream", "start_batches", "start_scan"]
