"""All queries by name, with their SQL."""

from __future__ import annotations

from . import roundtrips  # noqa: F401  registers its queries
from .oracles import SQL
from .queries import QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
