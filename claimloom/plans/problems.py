"""Queries of the general data problems that belong to the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimloom.operators import quantities


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return quantities.found(_t(spark, sf, "extracted_claims"), _t(spark, sf, "outcomes"), _t(spark, sf, "measures"), _t(spark, sf, "unit_constants"))


QUERIES = {"p4_found": p4_found}
