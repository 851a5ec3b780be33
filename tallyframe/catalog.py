"""The reconciliation queries by name, each with its SQL."""

from __future__ import annotations

from .plans import boundary_queries, evaluation_queries, matching_queries, report_queries  # noqa: F401
from .plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
