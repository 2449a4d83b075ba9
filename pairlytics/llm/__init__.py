"""Operators for preparing training text; self-contained, imported by nothing else in the library."""

from .queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
