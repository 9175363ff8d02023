"""All queries over the library's operators, by name."""

from __future__ import annotations

from . import clusters, evaluation, stores, texts, timelines  # noqa: F401
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
