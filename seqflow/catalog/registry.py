"""Name -> query function, and name -> the same result in SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqflow.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
_MODULES = ("selection", "sequences", "batches", "hits", "runs", "files", "search", "streams")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in _queries:
            raise ValueError(f"duplicate query {name}")
        _queries[name] = fn
        if sql is not None:
            _sql[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Stored times carry no zone; SQL reads them as UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"seqflow.catalog.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
