"""Registered queries: a Spark callable per operator plus its DuckDB oracle SQL.

Each Spark callable takes ``(spark, sf_dir)`` and returns a DataFrame over the
whole test tables. The SQL reads the same tables (registered as views) and must
produce the same column names; S-checkable operators carry SQL, property-only
(P) operators do not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


_SMALL_INTS = ("int", "smallint", "tinyint")


def normalise_types(df: DataFrame) -> DataFrame:
    """Integer columns as BIGINT (DuckDB's count / row_number type)."""
    casts = {c: df[c].cast("bigint") for c, t in df.dtypes if t in _SMALL_INTS}
    return df.withColumns(casts) if casts else df


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return normalise_types(fn(spark, sf_dir))

        run.__doc__ = fn.__doc__
        run.__name__ = fn.__name__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module so that it registers itself."""
    from . import (  # noqa: F401
        q_catalog, q_forecast, q_geo, q_jobs, q_models, q_prepare, q_report, q_review, q_rules, q_segment, q_stats)
