"""All registered queries over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *also: str):
    """Registers a query under its function's name (without ``_query``), and the names
    ``also``, with its SQL if there is one."""

    def add(f):
        for name in (f.__name__.removesuffix("_query"), *also):
            QUERIES[name] = f
            if sql is not None:
                ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


from . import audits, encoding, generation, ingest, metrics, neighbours, sampling  # noqa: E402, F401
