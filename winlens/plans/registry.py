"""All queries of the engine's own operators, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from winlens.plans import q_events, q_incidents, q_ml, q_models, q_runs, q_sources, q_text, q_windows

MODULES = [q_windows, q_models, q_events, q_text, q_incidents, q_runs, q_sources, q_ml]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_windows.flagship(spark, sf_dir)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
