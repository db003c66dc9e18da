"""Where queries are registered, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cutloom.sources import derived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The derived media tables of one folder, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if hasattr(derived, name):
            return getattr(derived, name)(self.spark, self.sf_dir)
        return derived.read(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None, *, base: bool = True):
    """Registers a function of :class:`Tables`; ``sql`` follows on the derived tables if ``base``."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = (derived.SQL + sql) if base else sql
        return f

    return add
