"""Registered queries: T-SQL over the tables of a folder, and the same in the oracle's SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidewater.session import Engine

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def open_folder(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine whose tables are the folder's, read when a query asks."""
    engine = Engine(spark, seed=1)
    engine.register_folder(sf_dir, TABLES)
    return engine


@dataclass(frozen=True)
class Query:
    name: str
    tsql: str
    oracle: str | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return open_folder(spark, sf_dir).query(self.tsql)


def runnable(found: list[Query]) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.name: q.run for q in found}


def oracles(found: list[Query]) -> dict[str, str]:
    return {q.name: q.oracle for q in found if q.oracle}
