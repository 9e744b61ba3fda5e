"""The registered queries and their SQL, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import regressions, series, shocks, signals, streams


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regressions.flagship(spark, sf_dir)


def _all() -> dict:
    return series.QUERIES | shocks.QUERIES | regressions.QUERIES | signals.QUERIES | streams.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in _all().items() if text}
