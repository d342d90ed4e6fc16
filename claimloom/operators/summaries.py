"""Summaries of runs and evaluations. Each is one grouped aggregation: partly aggregated before its shuffle, a few rows out.

Shares and means of a group without members are null; an empty table yields no row but for those over everything, which count 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _mean(c: Column, where: Column, places: int = 4) -> Column:
    return F.round(F.avg(F.when(where, c.cast("double"))), places)


def _over_all_and(df: DataFrame, kind: str, aggregates: Sequence[Column]) -> DataFrame:
    """Over everything (``all``) and by a kind, in one pass."""
    return df.rollup(kind).agg(F.grouping(kind).alias("_g"), *aggregates).withColumn(kind, F.when(F.col("_g") == 1, "all").otherwise(F.col(kind).cast("string"))).drop("_g")


def retrieval_items(hits: DataFrame, gold: DataFrame, items: DataFrame, *, cite: int = 5, threshold: float = 0.5) -> DataFrame:
    """One row an item of what its retrieval amounts to.

    ``items``: item_id, question_type, expected_answer_type; ``hits``: item_id, claim_id, score, rank; ``gold``: item_id, claim_id.
    The first ``cite`` hits are cited unless the best score is below ``threshold``: then the item abstains. Items without an
    answer have no metrics but whether abstaining was right.
    """
    none = F.col("expected_answer_type") == "no_answer"
    top = hits.groupBy("item_id").agg(F.max("score").alias("max_similarity"), F.least(F.count("*"), F.lit(cite)).alias("_c"))
    n = gold.select("item_id", "claim_id").distinct().groupBy("item_id").agg(F.count("*").alias("_n"))
    met = hits.join(gold.select("item_id", "claim_id").distinct(), ["item_id", "claim_id"], "left_semi").groupBy("item_id").agg(F.min("rank").alias("_first"), F.count_if(F.col("rank") <= cite).alias("_hit"))
    j = items.join(top, "item_id", "left").join(n, "item_id", "left").join(met, "item_id", "left")
    abstained = F.coalesce("max_similarity", F.lit(0.0)) < threshold
    hit = F.when(abstained, 0).otherwise(F.coalesce("_hit", F.lit(0)))
    shown = lambda c: F.when(~none, c)
    return j.select(
        "item_id", "question_type", "expected_answer_type", F.coalesce("max_similarity", F.lit(0.0)).alias("max_similarity"), abstained.alias("abstained"), F.when(abstained, 0).otherwise(F.coalesce("_c", F.lit(0))).cast("int").alias("n_cited"),
        shown((hit > 0).cast("int")).alias("claim_hit"), shown(F.round(F.coalesce(F.try_divide(hit, F.col("_n")), F.lit(0.0)), 6)).alias("claim_recall"), shown(F.round(F.coalesce(1 / F.col("_first"), F.lit(0.0)), 6)).alias("mrr"), F.when(none, abstained).alias("no_answer_correct"),
    )


def retrieval(items: DataFrame, kind: str = "question_type") -> DataFrame:
    """Retrieval items over all and by type of question: items with an answer and without one are told apart."""
    none = F.col("expected_answer_type") == "no_answer"
    some = ~none
    return _over_all_and(
        items,
        kind,
        [
            F.count("*").alias("count"), F.round(F.avg("n_cited"), 2).alias("avg_cited_claims"), F.round(F.avg("max_similarity"), 4).alias("avg_max_similarity"), F.count_if(some).alias("graph_positive_count"),
            _mean(F.col("claim_hit"), some).alias("claim_hit"), _mean(F.col("claim_recall"), some).alias("claim_recall"), _mean(F.col("mrr"), some).alias("mrr"), _mean(F.col("abstained").cast("int"), some).alias("false_abstention_rate"),
            F.count_if(none).alias("no_answer_count"), _mean(F.col("no_answer_correct").cast("int"), none).alias("no_answer_correct"), _mean(F.col("abstained").cast("int"), none).alias("abstention_rate"),
        ],
    )


def answers(items: DataFrame, kind: str = "question_type") -> DataFrame:
    """Answers of an agent over all and by type of question.

    ``items``: success, json_parse_success, tool_call_count, expected_answer_type, n_gold_pmids, n_gold_claims, pmid_hit,
    pmid_recall, claim_hit, claim_recall, abstained, no_answer_correct. Items with an answer but no gold at all are for review.
    """
    none = F.col("expected_answer_type") == "no_answer"
    by_pmid, by_claim = ~none & (F.col("n_gold_pmids") > 0), ~none & (F.col("n_gold_claims") > 0)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int")
    out = _over_all_and(
        items,
        kind,
        [
            F.count("*").alias("count"), F.round(F.avg(flag("success")), 4).alias("success_rate"), F.round(F.avg(flag("json_parse_success")), 4).alias("json_parse_rate"), F.round(F.avg("tool_call_count"), 2).alias("avg_tool_calls"),
            F.count_if(~none).alias("graph_positive_count"), F.count_if(by_pmid).alias("pmid_labeled_count"), F.count_if(by_claim).alias("claim_labeled_count"), F.count_if(~none & ~by_pmid & ~by_claim).alias("external_review_count"),
            _mean(F.col("pmid_hit"), by_pmid).alias("pmid_hit"), _mean(F.col("pmid_recall"), by_pmid).alias("pmid_recall"), _mean(F.col("claim_hit"), by_claim).alias("claim_hit"), _mean(F.col("claim_recall"), by_claim).alias("claim_recall"),
            F.count_if(none).alias("no_answer_count"), _mean(flag("no_answer_correct"), none).alias("no_answer_correct"), _mean(flag("abstained"), none).alias("abstention_rate"),
        ],
    )
    return out.withColumn("primary_metric", F.when(F.col("graph_positive_count") > 0, F.when(F.col("pmid_labeled_count") > 0, "pmid_recall").otherwise("external_review_required")))


def compatibility(items: DataFrame, kind: str = "question_type") -> DataFrame:
    """Mean coverage and recalls over all and by type, and how many items are of each category (``category`` null: all of them)."""
    means = [F.round(F.avg(c), 4).alias(f"avg_{c}") for c in ("coverage", "recall_10", "recall_20")]
    both = items.cube(kind, "category").agg(F.grouping(kind).alias("_k"), F.grouping("category").alias("_c"), F.count("*").alias("n"), *means)
    return both.select(F.when(F.col("_k") == 1, "all").otherwise(F.col(kind).cast("string")).alias(kind), F.when(F.col("_c") == 0, F.col("category")).alias("category"), "n", *[f"avg_{c}" for c in ("coverage", "recall_10", "recall_20")])


def scores(rows: DataFrame, *, high: float = 70.0) -> DataFrame:
    """Mean relevance and quality, and how many papers are of high quality and have a full text."""
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("relevance"), 2).alias("avg_relevance"), F.round(F.avg("overall"), 2).alias("avg_quality"), F.count_if(F.col("overall") >= high).alias("high_quality_count"), F.count_if("has_full_text").alias("with_xml_count"))


def evidence(rows: DataFrame, *, text: str = "evidence_snippet", backfilled: str | None = None) -> DataFrame:
    """How much of the evidence has a snippet, and how much has one that was filled in later."""
    empty = F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) == 0
    later = F.count_if(F.coalesce(F.col(backfilled), F.lit(False))) if backfilled else F.lit(0).cast("bigint")
    return rows.agg(F.count("*").alias("total"), F.count_if(empty).alias("empty"), F.count_if(~empty).alias("nonempty"), later.alias("backfilled"))


def levels(rows: DataFrame) -> DataFrame:
    """How many articles reach each level of completeness, and how many of them want a full text."""
    each = rows.groupBy("level").agg(F.count("*").alias("n"), F.count_if(~F.col("has_full_text") & (F.col("missing") != "")).alias("need_full_text"))
    total = rows.agg(F.count("*").alias("_t"))
    return each.crossJoin(total).select("level", "n", F.round(F.col("n") * 100 / F.col("_t"), 1).alias("percent"), "need_full_text")  # one row to four


def judged(judgments: DataFrame, *, least: float = 0.5) -> DataFrame:
    """``relevance`` of every judged item: uncertain if its confidence is below ``least``, failed without a label."""
    return judgments.withColumn("relevance", F.when(F.col("relevance").isNull(), "failed").when(F.coalesce("confidence", F.lit(0.0)) < least, "UNCERTAIN").otherwise(F.col("relevance")))


def relevance(judgments: DataFrame, *, least: float = 0.5) -> DataFrame:
    """How many items were found relevant, partially, not, left uncertain, and how many judgments failed."""
    at = lambda x: F.count_if(F.col("relevance") == x)
    return judged(judgments, least=least).agg(F.count("*").alias("total"), F.count_if(F.col("relevance") != "failed").alias("processed"), at("RELEVANT").alias("relevant"), at("PARTIALLY").alias("partially"), at("NOT_RELEVANT").alias("not_relevant"), at("UNCERTAIN").alias("uncertain"), at("failed").alias("failed"))


def selected(articles: DataFrame, judgments: DataFrame, *, least: float = 0.5, labels: Sequence[str] = ("RELEVANT", "PARTIALLY"), key: str = "pmid") -> DataFrame:
    """Articles judged relevant, with their judgment. Of several judgments of one article the most confident counts."""
    j = judged(judgments, least=least).where(F.col("relevance").isin(*labels)).groupBy(key).agg(F.max(F.struct("confidence", "relevance")).alias("j"))
    return articles.join(j, key).select(*articles.columns, F.col("j.relevance").alias("relevance"), F.col("j.confidence").alias("relevance_confidence"))


def accepted(candidates: DataFrame, needed: int, *, least: float = 0.7) -> DataFrame:
    """The first ``needed`` candidates by rank that were to be included with confidence, are usable and in scope. A limit that is asked for."""
    fit = candidates.where(F.col("include") & (F.coalesce("confidence", F.lit(0.0)) >= least) & F.col("usable") & F.col("in_scope"))
    return fit.orderBy("rank", "pmid").limit(needed)


def filtered(rows: DataFrame, *, min_quality: float = 70.0, min_relevance: float = 3.0, require_text: bool = False, top: int | None = None) -> DataFrame:
    """Papers of enough quality and relevance, the best first (ties by pmid), all or the first ``top``."""
    out = rows.where((F.col("overall") >= min_quality) & (F.col("relevance") >= min_relevance))
    out = (out.where("has_full_text") if require_text else out).orderBy(F.desc("overall"), "pmid")
    return out.limit(top) if top else out


GRADES = {"A+": 12, "A": 11, "A-": 10, "B+": 9, "B": 8, "B-": 7, "C+": 6, "C": 5, "C-": 4, "D": 3, "F": 2}


def included(rows: DataFrame, *, min_grade: str = "C", min_score: float = 0.0) -> DataFrame:
    """Papers of a grade and score at least, with ``include``; an unknown least grade counts as C."""
    order = F.create_map(*[F.lit(x) for kv in GRADES.items() for x in kv])
    return rows.withColumn("include", (F.coalesce(order[F.col("grade")], F.lit(0)) >= GRADES.get(min_grade, 5)) & (F.col("total") >= min_score))


def page(rows: DataFrame, order: str, *, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows from an offset on, in an order that tells all rows apart; the offset is found by a global sort, not by numbering all rows in one task."""
    out = rows.orderBy(order).offset(offset)
    return out.limit(limit) if limit is not None else out


def high_confidence(label: Column, direction: Column, confidence: Column, sentence: Column) -> Column:
    """Grounded with confidence: the sentence supports the claim and its direction."""
    return F.coalesce((label == "supports") & (direction == "yes") & (F.coalesce(confidence, F.lit(0.0)) >= 0.7) & (F.length(F.coalesce(sentence, F.lit(""))) > 0), F.lit(False))


def grounded(verdicts: DataFrame) -> DataFrame:
    """Verdicts made consistent: support without a supported direction is insufficient, with confidence 0.5 at most; without a sentence confidence is 0.3 at most."""
    label = F.when((F.col("support_label") == "supports") & (F.coalesce("direction_supported", F.lit("")) != "yes"), "insufficient").otherwise(F.coalesce("support_label", F.lit("insufficient")))
    capped = F.when(label != F.coalesce("support_label", F.lit("insufficient")), F.least("confidence", F.lit(0.5))).otherwise(F.col("confidence"))
    bare = F.length(F.coalesce("best_sentence", F.lit(""))) == 0
    return verdicts.withColumns({"support_label": label, "confidence": F.when(bare, F.least(capped, F.lit(0.3))).otherwise(capped)})


def annotated(merged: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Merged claims with their verdict, of several the one with the largest ``ordinal``; claims without one stay unverified."""
    last = verdicts.groupBy("claim_id").agg(F.max_by(F.struct("support_label", "direction_supported", "confidence", "best_sentence", "effect_direction", "health_interpretation"), "ordinal").alias("v"))
    j = merged.select("claim_id").join(last, "claim_id", "left")
    had = F.col("v").isNotNull()
    return j.select(
        "claim_id", F.when(had, F.coalesce("v.effect_direction", F.lit("unclear"))).alias("effect_direction_verified"), F.when(had, F.coalesce("v.health_interpretation", F.lit("unclear"))).alias("health_interpretation_verified"), F.when(had, F.coalesce("v.support_label", F.lit("unverified"))).alias("grounding_status"),
        F.when(had, F.coalesce("v.direction_supported", F.lit("unclear"))).alias("direction_supported"), F.when(had, high_confidence(F.col("v.support_label"), F.col("v.direction_supported"), F.col("v.confidence"), F.col("v.best_sentence"))).alias("high_confidence_grounded"),
    )


VERDICTS = {
    "support_label": ("supports", "contradicts", "insufficient"), "direction_supported": ("yes", "no", "unclear"), "effect_direction": ("increased", "decreased", "changed", "no_significant_effect", "associated", "mixed", "unclear"),
    "health_interpretation": ("beneficial", "harmful", "neutral", "mixed", "unclear"),
}


def verdicts(rows: DataFrame) -> DataFrame:
    """``field``, ``label``, ``n`` of all labels there can be, also those that none has."""
    one = rows.agg(*[F.count_if(F.col(f) == x).alias(f"{f}|{x}") for f, labels in VERDICTS.items() for x in labels])
    pairs = [(f, x) for f, labels in VERDICTS.items() for x in labels]
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(x).alias("label"), F.col(f"`{f}|{x}`").alias("n")) for f, x in pairs])).alias("r")).select("r.*")


def crossed(rows: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of two labels, one column a given value."""
    return rows.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def rated(rows: DataFrame, kind: str, rating: str) -> DataFrame:
    """Ratings by what was expected beforehand: their number, mean, and the share of 4 and more."""
    return rows.groupBy(kind).agg(F.count(rating).alias("n"), F.round(F.avg(rating), 4).alias("mean"), F.round(F.avg((F.col(rating) >= 4).cast("int")), 4).alias("share_high"))


def checked(rows: DataFrame, annotations: DataFrame, *, key: str, labels: Sequence[str], column: str) -> DataFrame:
    """What keeps annotations from being joined: ``problem`` and ``n`` of rows without one, of keys annotated more than once, and of labels that are none. No row: they fit."""
    twice = annotations.groupBy(key).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("duplicate").alias("problem"), "n")
    without = rows.select(key).distinct().join(annotations.select(key), key, "left_anti").agg(F.count("*").alias("n")).select(F.lit("missing").alias("problem"), "n")
    bad = annotations.where(~F.coalesce(F.col(column).isin(*labels), F.lit(False))).agg(F.count("*").alias("n")).select(F.lit("bad label").alias("problem"), "n")
    return twice.unionByName(without).unionByName(bad).where("n > 0")


def quotas(n: int, shares: dict[str, float], rest: str) -> dict[str, int]:
    """Shares of n, each rounded half to even; what is left over goes to ``rest``."""
    out = {k: round(n * v) for k, v in shares.items()}
    out[rest] = out.get(rest, 0) + n - sum(out.values())
    return out
