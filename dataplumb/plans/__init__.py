"""Registered queries over the test tables, with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import anomalies, checks, formats, more, personal, scalars, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**checks.QUERIES, **tables.QUERIES, **scalars.QUERIES, **anomalies.QUERIES, **personal.QUERIES, **more.QUERIES, **formats.QUERIES}
ORACLES: dict[str, str] = {**checks.ORACLES, **tables.ORACLES, **scalars.ORACLES, **anomalies.ORACLES, **personal.ORACLES, **more.ORACLES, **formats.ORACLES}
