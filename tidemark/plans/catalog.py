"""All queries of the library."""

from __future__ import annotations

from . import books, corpora, ingest, panels, risks, streams, ticks  # noqa: F401  they register themselves
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
