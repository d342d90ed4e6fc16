"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimloom.plans import evidence, problems, sources, summaries
from claimloom.session import ship


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ship(spark)
        return f(spark, sf)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _shipped(f) for k, f in (evidence.QUERIES | problems.QUERIES).items()}


def oracle_sql() -> dict[str, str]:
    return dict(sources.E.SQL | summaries.E.SQL)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """The merged claims with most evidence."""
    return evidence.claims_merged(spark, sf).orderBy("evidence_count", "claim_id", ascending=[False, True]).limit(20)
