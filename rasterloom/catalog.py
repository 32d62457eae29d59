"""Registered queries over the tables, and the SQL that checks them."""

from __future__ import annotations

from rasterloom.plans import containers, tables

__all__ = ["containers", "oracle_sql", "queries"]


def queries() -> dict:
    return dict(tables.QUERIES)


def oracle_sql() -> dict:
    return dict(tables.ORACLE)
