"""All named queries."""

from __future__ import annotations

from reviewlytics.plans import model_queries, report_queries, text_queries, training_queries
from reviewlytics.plans.base import Query

_PARTS = (
    text_queries.registry, model_queries.registry, report_queries.registry, training_queries.registry,
)


def queries() -> dict[str, Query]:
    return {name: q for part in _PARTS for name, q in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for part in _PARTS for name, s in part.sql.items()}
