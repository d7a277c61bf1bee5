"""Every registered query."""

from __future__ import annotations

from .registry import Query


def all_queries() -> list[Query]:
    from . import curve_queries, history_queries, ingest_queries, quality_queries, report_queries

    found: list[Query] = []
    for module in (history_queries, report_queries, curve_queries, quality_queries, ingest_queries):
        found.extend(module.queries())
    return found
