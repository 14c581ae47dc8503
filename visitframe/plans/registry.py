"""All registered queries of the core library and their DuckDB equivalents."""

from __future__ import annotations

from visitframe.plans import cleaning_queries, conflict_queries, matching_queries, model_queries, profile_queries, validation_queries, visit_queries  # noqa: F401
from visitframe.plans.base import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
