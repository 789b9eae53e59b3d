"""All registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.plans import causal, export, ingest, reports, series

MODULES = (ingest, reports, series, causal)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def exported(fn):
        return lambda spark, sf_dir: export(fn(spark, sf_dir))

    return {name: exported(fn) for m in MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
