"""Operators for training-data pipelines; nothing else in the library imports this."""

from .queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
