"""Audit statistics: agreement of two reviewers, rates of labels, their resolution, cross tables and stratified samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LABELS = ("yes", "no", "unclear")


def clean_label(c: Column) -> Column:
    """yes, no, unclear, or null for anything else."""
    s = F.lower(F.regexp_replace(c, r"^[\s\x{a0}]+|[\s\x{a0}.]+$", ""))
    return F.when(s.isin("yes", "y"), "yes").when(s.isin("no", "n"), "no").when(s.isin("unclear", "?"), "unclear")


def long_labels(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row a decision and field with its cleaned label; decisions without one are left out."""
    rows = df.select("audit_id", "reviewer_id", "decision_id", "decided_at", *[clean_label(F.col(f)).alias(f) for f in fields])
    pairs = ", ".join(f"'{f}', {f}" for f in fields)
    return rows.selectExpr("audit_id", "reviewer_id", "decision_id", "decided_at", f"stack({len(fields)}, {pairs}) as (field, label)").where("label is not null")


def double_reviews(labels: DataFrame) -> DataFrame:
    """The first two reviewers of every item and field, by reviewer id, with their latest labels."""
    last = labels.groupBy("audit_id", "field", "reviewer_id").agg(F.max_by("label", F.struct("decided_at", "decision_id")).alias("label"))
    order = Window.partitionBy("audit_id", "field").orderBy("reviewer_id")
    two = last.withColumn("_r", F.row_number().over(order)).where("_r <= 2")
    return two.groupBy("audit_id", "field").agg(F.max(F.when(F.col("_r") == 1, F.col("label"))).alias("a"), F.max(F.when(F.col("_r") == 2, F.col("label"))).alias("b")).where("a is not null and b is not null")


def resolved(pairs: DataFrame) -> DataFrame:
    """Equal labels stay; if either is no it is no; else unclear."""
    return pairs.withColumn("label", F.when(F.col("a") == F.col("b"), F.col("a")).when((F.col("a") == "no") | (F.col("b") == "no"), "no").otherwise("unclear"))


def kappa(pairs: DataFrame) -> DataFrame:
    """Cohen's kappa for each field, 1 if both give one and the same label throughout."""
    share = [F.avg((F.col(c) == x).cast("double")).alias(f"_{c}_{x}") for c in "ab" for x in LABELS]
    m = pairs.groupBy("field").agg(F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("observed"), *share)
    expected = sum((F.col(f"_a_{x}") * F.col(f"_b_{x}") for x in LABELS[1:]), F.col(f"_a_{LABELS[0]}") * F.col(f"_b_{LABELS[0]}"))
    value = F.when(expected > 1 - 1e-12, 1.0).otherwise((F.col("observed") - expected) / (1 - expected))
    return m.select("field", "n", F.round("observed", 4).alias("observed"), F.round(value, 4).alias("kappa"))


def rates(labels: DataFrame, by: Sequence[str] = ("field",)) -> DataFrame:
    """Counts of the labels, precision without unclear ones (null without any), and shares of yes and unclear."""
    n = {x: F.count_if(F.col("label") == x) for x in LABELS}
    return labels.groupBy(*by).agg(
        *[v.alias(f"n_{x}") for x, v in n.items()],
        F.round(F.try_divide(n["yes"], n["yes"] + n["no"]), 4).alias("precision"),
        F.round(n["yes"] / F.count("*"), 4).alias("yes_rate"),
        F.round(n["unclear"] / F.count("*"), 4).alias("unclear_rate"),
    )


def crosstab(pairs: DataFrame) -> DataFrame:
    """How often each label of the first reviewer meets each of the second; all pairs of labels are there, with 0 where they never meet."""
    counted = pairs.groupBy("field", "a").pivot("b", list(LABELS)).count()
    spark = pairs.sparkSession
    grid = pairs.select("field").distinct().join(spark.createDataFrame([(x,) for x in LABELS], "a string"))  # three rows
    return grid.join(counted, ["field", "a"], "left").na.fill(0, list(LABELS))


def stratified(df: DataFrame, stratum: str, key: str, quotas: dict[str, int], seed: str) -> DataFrame:
    """A sample of so many rows of each stratum, in the order of a hash of the key; the same for every partitioning."""
    order = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(seed + "|"), F.col(key).cast("string"))), key)
    quota = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])[F.col(stratum)]
    return df.where(F.col(stratum).isin(*quotas)).withColumn("draw", F.row_number().over(order)).where(F.col("draw") <= quota)
