"""Named queries over the driver tables, each with the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register a query function; sql is None where SQL cannot express it."""

    def keep(f):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = (f, sql)
        return f

    return keep


def _load() -> None:
    import importlib

    for module in ("catalogue", "audits", "exhibits", "replays", "scalars", "workflows"):
        importlib.import_module(f"veriframe.plans.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {k: f for k, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: s for k, (_, s) in _QUERIES.items() if s}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["q01_price_groups"](spark, sf_dir)
