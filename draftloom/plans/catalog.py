"""All named queries of the engine."""

from __future__ import annotations

from . import browse, crawl, desk, extra, extraction, geometry, ingest, relations, reports, search, text  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "queries", "oracle_sql"]


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
