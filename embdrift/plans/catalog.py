"""Registry of named queries: a Spark builder plus (optionally) DuckDB oracle SQL.

Each query reads the given tables (or views Spark derives from them) through
``Tables`` so its work grows with the input.  The oracle SQL runs on the same
parquet files with the tables registered as views.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from embdrift.sources.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None
    operators: tuple[str, ...]
    bench: bool = False


_REGISTRY: dict[str, Query] = {}


def register(name: str, *, sql: str | None, operators: tuple[str, ...] = (), bench: bool = False):
    def deco(fn: Callable[[Tables], DataFrame]):
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = Query(name, fn, sql, operators, bench)
        return fn
    return deco


def _load_all() -> None:
    # Importing the modules registers their queries.
    from embdrift.plans import (  # noqa: F401
        drift_queries, ingest_queries, text_queries, retrieval_queries,
        training_queries, policy_queries, governance_queries,
    )


def registry() -> dict[str, Query]:
    _load_all()
    return dict(_REGISTRY)


def runner(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return q.build(Tables(spark, sf_dir))
    run.__name__ = q.name
    return run
