"""Ledger queries and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import actions, alerts, buckets, catalog, curves, events, evidence, fundamentals, performance, periods, progress, receipts, relational, scalars, selection, statements, valuation

_MODULES = (relational, performance, events, fundamentals, scalars, selection, actions, valuation, periods, buckets, curves, evidence, statements, receipts, alerts, progress, catalog)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
