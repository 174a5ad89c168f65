"""Registered queries over the test tables, with their SQL."""

from __future__ import annotations

from . import extras, market, reports, research


def queries() -> dict:
    return market.QUERIES | research.QUERIES | reports.QUERIES | extras.QUERIES


def oracle_sql() -> dict[str, str]:
    return market.SQL | research.SQL | reports.SQL | extras.SQL
