"""Queries over the engine's operators, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.plans import dialect, functional, ranked, registry, relational, statements  # noqa: F401  (they register)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pricing summary: pushed-down filter, partial aggregation, small result."""
    return registry.QUERIES["agg_group"](spark, sf_dir)


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLE)
