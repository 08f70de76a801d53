"""Registered queries over the given tables, each with its SQL twin where SQL can express it."""

from registry import combining, comparing, dashboards, features, information, learning, mended, profiling, texts  # noqa: F401
from registry.base import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
