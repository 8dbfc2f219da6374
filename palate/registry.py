"""The engine's registered queries and their SQL."""

from __future__ import annotations

from palate.plans import queries as plans

flagship = plans.flagship


def queries() -> dict:
    return dict(plans.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(plans.SQL)
