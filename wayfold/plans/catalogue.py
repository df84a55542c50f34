"""All queries of the engine by name, and their equivalents in SQL."""

from __future__ import annotations

from wayfold.plans import admin_queries, curation_queries, job_queries, match_queries, page_queries, place_queries, text_queries  # noqa: F401  they register themselves
from wayfold.plans.registry import ORACLE, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
