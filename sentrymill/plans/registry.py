"""All telemetry queries by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from . import archive, capture, dashboard, evidence, intel, lookups, places, reads, stored  # noqa: F401  (they register their queries)
from .base import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
