"""The registered queries over the engine's own operators, each with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.plans import changes, functions, relational, system, windows
from tidewater.plans.runner import oracles, runnable

ALL = [*relational.QUERIES, *windows.QUERIES, *functions.QUERIES, *changes.QUERIES, *system.QUERIES]


def queries() -> dict:
    return runnable(ALL) | changes.DIRECT | system.DIRECT


def oracle_sql() -> dict:
    return oracles(ALL) | changes.DIRECT_ORACLES | system.DIRECT_ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best customers by what they ordered."""
    return queries()["top_n"](spark, sf_dir)
