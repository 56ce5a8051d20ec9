"""Where queries are registered, each with its SQL twin if SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docmill.sources.files import spread

Tables = Callable[[str], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


#: Tables of whole texts, which cost far more to read into than to move.
TEXTS = ("documents", "pages", "conversations")


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Reads a table of the folder by name."""

    def read(name: str) -> DataFrame:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return spread(table) if name in TEXTS else table

    return read


def query(name: str, sql: str | None = None):
    """Register a function of the tables under a name."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return build

    return register
