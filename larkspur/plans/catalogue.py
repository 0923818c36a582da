"""All registered queries of the library and their SQL."""

from __future__ import annotations

from . import answers, graphs, memories, search, stores
from .registry import QUERIES, SQL

_MODULES = (search, graphs, memories, stores, answers)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
