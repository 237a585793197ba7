"""Names of the registered queries, with their DuckDB counterparts."""

from __future__ import annotations

from . import oracle
from .queries import QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return oracle.oracle_sql()
