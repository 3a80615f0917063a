"""Registry of the review-evidence queries and their DuckDB counterparts."""

from __future__ import annotations

from . import corpus, display, evidence, extensions, latex, markup, policies, publication, ranges, relations  # noqa: F401  (importing registers their queries)
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
