"""Registry of named jobs: one Spark callable and (optionally) one DuckDB oracle SQL each.

Job modules register with ``@job("name", sql=...)``; ``__spark_entry__`` only
reads this registry.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.session import ensure_runtime_conf

_JOBS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def job(name: str, sql: str | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        if name in _JOBS:
            raise ValueError(f"duplicate job {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_runtime_conf(spark)
            return fn(spark, sf_dir)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        _JOBS[name] = run
        if sql is not None:
            _SQL[name] = sql
        return fn

    return deco


def oracle_sql_of(name: str) -> str:
    """SQL of a job that is registered already."""
    return _SQL[name]


def _load_all() -> None:
    # import for the registration side effect
    from tidewater.jobs import (  # noqa: F401
        ingest_jobs, matching_jobs, normalize_jobs, outlook_jobs, report_jobs,
        search_jobs, stream_jobs, workflow_jobs,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return dict(_JOBS)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_SQL)
