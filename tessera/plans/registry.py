"""Registry of named queries: key -> (Spark callable, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import utc

QueryFn = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``key``."""
    def deco(fn):
        if key in _QUERIES:
            raise ValueError(f"duplicate query key {key!r}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with utc(spark):
                return fn(spark, sf_dir)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        _QUERIES[key] = run
        if oracle is not None:
            _ORACLES[key] = oracle
        return fn
    return deco


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load_all()
    return dict(_ORACLES)


def _load_all() -> None:
    # Importing the modules registers their queries.
    from . import delivery_models, delivery_queries, model_queries, ratings_queries, spatial_queries, star_queries  # noqa: F401
