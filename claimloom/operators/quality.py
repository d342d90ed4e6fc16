"""Quality of an extraction run: summary, difference to an earlier run, completeness of evidence, and edit candidates from reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom import lexicons as L
from claimloom.functions import text


def summary(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """Measures of a run: articles, articles without an accepted claim, rejected records, suspicious and over-specific foods, claims with several records."""
    a = rows.groupBy("pmid").agg(F.count_if(F.col("reject_reason").isNull()).alias("kept"), F.count_if(F.col("reject_reason").isNotNull()).alias("lost"))
    articles = a.agg(F.count("*").alias("articles"), F.count_if(F.col("kept") == 0).alias("zero_claim_articles"), F.count_if(F.col("lost") > 0).alias("articles_with_warnings"), F.sum("lost").alias("rejected"))
    foods = merged.where("subject_type = 'food'").select("subject").distinct()
    named = foods.agg(F.count_if(text.is_suspicious_food(F.col("subject"))).alias("suspicious_foods"), F.count_if(text.is_over_specific(F.col("subject"))).alias("over_specific_foods"), F.count("*").alias("foods"))
    claims = merged.agg(F.count("*").alias("merged_claims"), F.count_if(F.col("evidence_count") > 1).alias("multi_evidence_claims"), F.countDistinct("object").alias("outcomes"))
    names = ["articles", "zero_claim_articles", "articles_with_warnings", "rejected", "suspicious_foods", "over_specific_foods", "foods", "merged_claims", "multi_evidence_claims", "outcomes"]
    one = articles.crossJoin(named).crossJoin(claims)  # three single rows
    return one.select(F.expr(f"stack({len(names)}, " + ", ".join(f"'{n}', cast({n} as bigint)" for n in names) + ") as (measure, n)"))


def validation(rows: DataFrame, most: int = 5) -> DataFrame:
    """For every article its claims, those kept, and the first ``most`` of what was rejected, as reason and subject, each once."""
    n = rows.groupBy("pmid").agg(F.count("*").alias("original"), F.count_if(F.col("reject_reason").isNull()).alias("kept"))
    bad = rows.where("reject_reason is not null").select("pmid", F.concat_ws(":", "reject_reason", "subject").alias("x")).distinct()
    first = bad.withColumn("_r", F.row_number().over(Window.partitionBy("pmid").orderBy("x"))).where(F.col("_r") <= most).groupBy("pmid").agg(F.array_sort(F.collect_list("x")).alias("invalid"))
    return n.join(first, "pmid", "left").withColumn("invalid", F.coalesce("invalid", F.array().cast("array<string>")))


def recommendation(measures: dict[str, int]) -> list[str]:
    """Reasons to review a run; none: it looks clean."""
    out = []
    if measures.get("suspicious_foods"):
        out.append("suspicious_foods_present")
    if measures.get("over_specific_foods"):
        out.append("over_specific_foods_present")
    if measures.get("zero_claim_articles", 0) >= 5:
        out.append("many_zero_claim_articles")
    return out or ["batch_looks_clean"]


def difference(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """What is new and what is gone: claim ids, foods and outcomes of two merged runs, one row each."""
    def keys(df: DataFrame) -> DataFrame:
        food = F.when(F.col("subject_type") == "food", F.struct(F.lit("food").alias("kind"), F.col("subject").alias("key")))
        each = F.array_compact(F.array(F.struct(F.lit("claim").alias("kind"), F.col("claim_id").alias("key")), food, F.struct(F.lit("outcome").alias("kind"), F.col("object").alias("key"))))
        return df.select(F.explode(each).alias("k")).select("k.kind", "k.key").distinct()

    both = keys(current).withColumn("now", F.lit(1)).unionByName(keys(baseline).withColumn("now", F.lit(0)))
    sides = both.groupBy("kind", "key").agg(F.max("now").alias("now"), F.min("now").alias("before"))
    return sides.where("now = before").select("kind", "key", F.when(F.col("now") == 1, "new").otherwise("gone").alias("change"))


def completeness(rows: DataFrame, full_text: DataFrame) -> DataFrame:
    """For every article which of seven parts of its evidence are there, and the level they make."""
    strain = F.col("subject_type") == "strain"
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    given = rows.groupBy("pmid").agg(
        has(strain & F.col("subject").rlike(r"\d")).alias("has_strain"),
        has(F.length(F.coalesce("dose", F.lit(""))) > 0).alias("has_dose"),
        has(F.length(F.coalesce("duration", F.lit(""))) > 0).alias("has_duration"),
        has(F.length(F.coalesce("effect_size", F.lit(""))) > 0).alias("has_effect"),
        has(F.length(F.coalesce("study_type", F.lit(""))) > 0).alias("has_study_type"),
    )
    texts = full_text.groupBy(text.strip(F.col("pmid")).alias("pmid")).agg(F.max(F.when(F.length(F.coalesce("pmcid", F.lit(""))) > 0, 1).otherwise(0)).alias("_pmc"), F.max(F.when(text.first_sample(F.coalesce("abstract", F.lit(""))).isNotNull(), 1).otherwise(0)).alias("_n"))
    out = given.join(texts, "pmid", "left").withColumns({"has_full_text": F.coalesce("_pmc", F.lit(0)) == 1, "has_sample_size": F.coalesce("_n", F.lit(0)) == 1}).drop("_pmc", "_n")
    parts = ("has_sample_size", "has_study_type", "has_full_text", "has_strain", "has_dose", "has_duration", "has_effect")
    score = sum((F.col(p).cast("int") for p in parts[1:]), F.col(parts[0]).cast("int"))
    level = F.when(score >= 6, "complete").when(score >= 4, "partial").when(score >= 2, "minimal").otherwise("insufficient")
    missing = F.array_join(F.array_compact(F.array(*[F.when(~F.col(p), p[4:]) for p in parts[:-1]])), ",")
    return out.withColumns({"score": score, "level": level, "missing": missing})


def issues(reviews: DataFrame, *, review: str = "review") -> DataFrame:
    """Edit candidates of review reports: one row for each section headed ``### ISSUE-n: [type] - entity``, with its fields."""
    section = reviews.select("review_id", F.posexplode(F.split(review, r"(?m)^###\s+")).alias("pos", "s")).select("review_id", "pos", F.trim("s").alias("s")).where(F.col("s").startswith("ISSUE-"))
    field = lambda k: F.trim(F.regexp_extract("s", rf"(?im)^[-*]\s*\*\*{k}\*\*:?[ \t]*:?[ \t]*(.*)$", 1))
    head = lambda i: F.trim(F.regexp_extract("s", r"^(ISSUE-\d+):\s*\[([^\]]*)\]\s*-\s*(.*)", i))
    out = section.select("review_id", "pos", head(1).alias("issue_id"), head(2).alias("issue_type"), head(3).alias("entity"), F.lower(field("Severity")).alias("severity"), text.action(field("Action")).alias("action"), field("PMIDs").alias("pmids"))
    return out.withColumn("severity", F.when(F.col("severity").isin(*L.SEVERITY_PRIORITY), F.col("severity")).otherwise("unknown"))


def selected(candidates: DataFrame, limit: int) -> DataFrame:
    """The most pressing candidates of every review: by severity, action and number, each issue, entity and action once."""
    rank = lambda c, table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col(c)]
    live = candidates.where(~F.col("action").isin("preserve", "no_change", "skip"))
    number = F.regexp_extract("issue_id", r"(\d+)", 1).cast("int")
    ranked = live.withColumns({"_s": F.coalesce(rank("severity", L.SEVERITY_PRIORITY), F.lit(3)), "_a": rank("action", L.ACTION_PRIORITY), "_n": number})
    once = ranked.groupBy("review_id", "issue_id", "entity", "action").agg(F.min(F.struct("_s", "_a", "_n", "pos", "severity")).alias("x"))
    order = Window.partitionBy("review_id").orderBy("x._s", "x._a", "x._n", "entity")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("review_id", "rank", "issue_id", "entity", "action", F.col("x.severity").alias("severity"))
