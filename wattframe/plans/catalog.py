
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``key`` with its SQL oracle."""
    def wrap(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle.strip()
        return fn
    return wrap


def load_all() -> None:
    # importing the modules fills the registry
    from wattframe.plans import (  # noqa: F401
        q_energy,
        q_prepare,
        q_summary,
        q_runs,
        q_models,
        q_stats,
        q_stream,
        q_sources,
    )
