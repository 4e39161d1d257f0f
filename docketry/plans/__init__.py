"""The catalogue of registered queries and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docketry.plans import catalog, kept, ordered, papers  # noqa: F401  the others add their queries to the catalogue


def queries() -> dict:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.ORACLE_SQL)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is due next: commitments in the notices, without repeats, in order."""
    return catalog.dedup_best(spark, sf_dir)
