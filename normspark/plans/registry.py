"""All queries of the engine by name, with the SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from normspark.plans import data_queries, drift_queries, more_queries, report_queries, study_queries

MODULES = [study_queries, data_queries, more_queries, report_queries, drift_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in MODULES:
        found |= module.QUERIES
    return found


def oracles() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in MODULES:
        found |= module.ORACLES
    return found


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conformal three-way decisions with operating metrics per category."""
    return queries()["selective_metrics"](spark, sf_dir)
