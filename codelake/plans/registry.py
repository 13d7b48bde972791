"""Where plans are entered with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """t.orders is the table orders."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def query(sql: str | None = None) -> Callable:
    def enter(plan: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[plan.__name__] = lambda spark, sf_dir: plan(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[plan.__name__] = sql
        return plan

    return enter
