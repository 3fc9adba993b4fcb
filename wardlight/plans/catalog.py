"""All registered queries and their DuckDB equivalents."""

from __future__ import annotations

from wardlight.plans import delegated_sql, operator_queries, store_queries, template_queries  # noqa: F401
from wardlight.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
