"""Benchmarks made from merged claims: diversified seeds, comparison groups, repair of gold claims, and compatibility with a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.functions import text, vectors
from claimloom.operators import summaries
from claimloom.session import bounded, written


def seeds(merged: DataFrame, n: int) -> DataFrame:
    """The n strongest claims with different subjects: by evidence, confidence and names, each subject once."""
    order = [F.desc("evidence_count"), F.desc("confidence"), "subject", "object", "claim_id"]
    per = merged.withColumn("_r", F.row_number().over(Window.partitionBy("subject").orderBy(*order))).where("_r = 1").drop("_r")
    top = per.orderBy(*order).limit(n)
    return top.withColumn("seed_rank", F.row_number().over(Window.orderBy(*order))).select("seed_rank", "claim_id", "subject", "object", "evidence_count")  # n rows


def diversified(merged: DataFrame, n: int = 35) -> DataFrame:
    """All claims as the reference lines them up: ``part`` 1, the n strongest with different subjects; 2, of the claims after the
    nth of those the strongest of each further pair of subject and object; 3, the others. Sorted; each part by evidence,
    confidence and names. With fewer than n subjects there is no part 2."""
    order = [F.desc("evidence_count"), F.desc("confidence"), "subject", "object", "claim_id"]
    merged = written(merged.select("claim_id", "subject", "object", "evidence_count", "confidence"), "claims-to-diversify")
    top = bounded(seeds(merged, n).join(merged.select("claim_id", "confidence"), "claim_id").orderBy("seed_rank"), n, "first claims")
    out = merged.join(F.broadcast(merged.sparkSession.createDataFrame([(r["claim_id"],) for r in top], "claim_id string")).withColumn("first", F.lit(True)), "claim_id", "left")
    part = F.when(F.col("first"), 1).otherwise(3)
    if len(top) == n:
        last = top[-1]
        key = lambda c: F.struct((-c("evidence_count")).cast("bigint").alias("e"), (-c("confidence")).cast("double").alias("c"), c("subject").alias("s"), c("object").alias("o"), c("claim_id").alias("i"))
        after = key(F.col) > key(lambda name: F.lit(last[name]))
        pair = Window.partitionBy("subject", "object")
        out = out.withColumn("later", after & F.col("first").isNull()).withColumn("taken", F.max(F.col("first")).over(pair)).withColumn("_r", F.row_number().over(Window.partitionBy("subject", "object", "later").orderBy(*order)))
        part = F.when(F.col("first"), 1).when(F.col("later") & F.col("taken").isNull() & (F.col("_r") == 1), 2).otherwise(3)
    return out.withColumn("part", part).orderBy("part", *order).select("part", "claim_id", "subject", "object", "evidence_count", "confidence")


#: Shares of the types of question; what rounding leaves goes to comparisons.
TYPE_SHARES = {"description": 0.34, "evidence_lookup": 0.21, "reason": 0.21, "comparison": 0.24}


def items(merged: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """Questions about single claims in the order of ``diversified``, by the shares of their types, each with its gold articles and the answer to expect. ``rows`` are the claims' records."""
    quota = summaries.quotas(size, TYPE_SHARES, "comparison")
    single = {t: n for t, n in quota.items() if t != "comparison"}
    order = ["part", F.desc("evidence_count"), F.desc("confidence"), "subject", "object", "claim_id"]
    top = diversified(merged).orderBy(*order).limit(sum(single.values()))
    top = written(top.withColumn("n", F.row_number().over(Window.orderBy(*order))), "question-claims")  # as many rows as questions
    kind, at = None, 0
    for t, n in single.items():
        at += n
        kind = F.when(F.col("n") <= at, t) if kind is None else kind.when(F.col("n") <= at, t)
    mine = rows.join(F.broadcast(top.select("claim_id")), "claim_id")  # as many as questions
    pmids = mine.where("pmid <> ''").select("claim_id", "pmid").distinct().groupBy("claim_id").agg(F.array_join(F.array_sort(F.collect_list("pmid")), ", ").alias("pmids"))
    snippet = mine.where("evidence_snippet <> ''").groupBy("claim_id").agg(F.min_by("evidence_snippet", "ordinal").alias("snippet"))
    out = top.join(pmids, "claim_id", "left").join(snippet, "claim_id", "left").join(merged.select("claim_id", "direction"), "claim_id")
    plain = lambda c: F.replace(F.col(c), F.lit("_"), F.lit(" "))
    answer = F.concat(F.lit("The graph supports that "), plain("subject"), F.lit(" has "), text.direction_phrase(F.col("direction")), F.lit(" on "), plain("object"), F.lit(". Gold evidence PMID(s): "), F.coalesce("pmids", F.lit("")), F.lit("."), F.when(F.col("snippet").isNotNull(), F.concat(F.lit(" Key source evidence: "), "snippet")).otherwise(""))
    return out.select("n", kind.alias("question_type"), "claim_id", "subject", "object", "pmids", answer.alias("expected_answer"))


def no_answer(merged: DataFrame, n: int, *, side: int = 30) -> DataFrame:
    """n questions the graph has no answer to: pairs of the ``side`` subjects and outcomes with most evidence that no claim connects, by their evidence. At most ``side`` squared pairs are looked at."""
    top = lambda c: bounded(merged.groupBy(c).agg(F.sum("evidence_count").alias("e")).orderBy(F.desc("e"), c).limit(side), side, f"top {c}s")
    merged = written(merged.select("subject", "object", "evidence_count"), "claims-asked")
    subjects, objects = top("subject"), top("object")
    grid = [(s["subject"], o["object"], s["e"] * o["e"]) for s in subjects for o in objects]
    pairs = merged.sparkSession.createDataFrame(grid, "subject string, object string, weight bigint")
    free = pairs.join(merged.select("subject", "object"), ["subject", "object"], "left_anti")
    return free.orderBy(F.desc("weight"), "subject", "object").limit(n).select("subject", "object", F.lit("no_answer").alias("expected_answer_type"))


def comparisons(merged: DataFrame, *, take: int = 3) -> DataFrame:
    """Outcomes with at least two subjects and their strongest claims, one a subject."""
    order = [F.desc("evidence_count"), F.desc("confidence"), "subject", "claim_id"]
    one = merged.withColumn("_r", F.row_number().over(Window.partitionBy("object", "subject").orderBy(*order))).where("_r = 1").drop("_r")
    top = one.withColumn("place", F.row_number().over(Window.partitionBy("object").orderBy(*order))).where(F.col("place") <= take)
    n = merged.groupBy("object").agg(F.countDistinct("subject").alias("n_subjects")).where("n_subjects >= 2")
    return top.join(n, "object").select("object", "n_subjects", "place", "subject", "claim_id")


def repaired_gold(gold: DataFrame, rows: DataFrame) -> DataFrame:
    """Current claim ids for benchmark items whose gold claims are gone.

    ``gold``: item_id, pmid, subject, object, direction, one row a gold pmid; ``rows``: accepted claim records. Candidates share
    a gold pmid and subject or outcome; of each item those with the most shared pmids, then subject, outcome and direction
    matches stay, all that tie.
    """
    n = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r"[-\s]+", "_"), "_+", "_")
    r = rows.select("pmid", "claim_id", n(F.col("subject")).alias("s"), n(F.col("object")).alias("o"), F.col("direction").alias("d")).distinct()
    j = gold.join(r, "pmid").withColumns({"sm": (n(F.col("subject")) == F.col("s")).cast("int"), "om": (n(F.col("object")) == F.col("o")).cast("int"), "dm": (F.col("direction") == F.col("d")).cast("int")}).where("sm + om > 0")
    c = j.groupBy("item_id", "claim_id").agg(F.countDistinct("pmid").alias("overlap"), F.max("sm").alias("sm"), F.max("om").alias("om"), F.max("dm").alias("dm"))
    best = Window.partitionBy("item_id").orderBy(F.desc("overlap"), F.desc("sm"), F.desc("om"), F.desc("dm"))
    return c.withColumn("_r", F.rank().over(best)).where("_r = 1").select("item_id", "claim_id", "overlap", "sm", "om", "dm")


def anchors(gold: DataFrame, rows: DataFrame) -> DataFrame:
    """For each item the claim of its gold pmids whose subject and outcome are most alike: both Jaccard similarities and their mean, ties to the smaller claim id."""
    r = rows.select("pmid", "claim_id", F.col("subject").alias("s"), F.col("object").alias("o")).distinct()
    alike = lambda a, b: vectors.jaccard(text.name_words(F.col(a)), text.name_words(F.col(b)))
    j = gold.join(r, "pmid").select("item_id", "claim_id", alike("subject", "s").alias("subject_score"), alike("object", "o").alias("outcome_score")).withColumn("score", F.round((F.col("subject_score") + F.col("outcome_score")) / 2, 6))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "claim_id")
    return j.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def compatibility(gold: DataFrame, rows: DataFrame, retrieved: DataFrame) -> DataFrame:
    """What a graph holds and retrieves of each item's gold.

    ``retrieved``: item_id, pmid, rank. Shares of the gold pmids that the graph holds and that are among the first 10 and 20
    retrieved, the best anchor claim of the gold pmids, and a category: the first that applies, from pmids that are absent over
    all, some, or only later ones retrieved, to how close the anchor is where none is.
    """
    g = gold.select("item_id", "pmid").distinct()
    held = rows.select("pmid").distinct().withColumn("held", F.lit(1))
    first = retrieved.groupBy("item_id", "pmid").agg(F.min("rank").alias("rank"))
    j = g.join(held, "pmid", "left").join(first, ["item_id", "pmid"], "left")
    n = j.groupBy("item_id").agg(F.count("*").alias("n"), F.count("held").alias("held"), F.count_if(F.col("rank") <= 10).alias("n10"), F.count_if(F.col("rank") <= 20).alias("n20"))
    out = n.join(anchors(gold, rows), "item_id", "left").na.fill(0.0, ["subject_score", "outcome_score", "score"])
    near = lambda c: F.round(c, 9) >= 0.8
    kind = (
        F.when(F.col("held") == 0, "gold_pmids_absent_from_new_graph")
        .when(F.col("n10") == F.col("n"), "all_gold_pmids_retrieved_top10")
        .when(F.col("n10") > 0, "partial_gold_pmids_retrieved_top10")
        .when(F.col("n20") > 0, "gold_pmids_rank_11_20")
        .when(near("subject_score") & near("outcome_score"), "anchor_claim_present_but_not_retrieved_top20")
        .when(near("subject_score") | near("outcome_score"), "gold_pmids_present_but_anchor_changed")
        .otherwise("gold_pmids_present_but_no_close_anchor")
    )
    share = lambda c: F.round(F.col(c) / F.col("n"), 4)
    return out.select("item_id", share("held").alias("coverage"), share("n10").alias("recall_10"), share("n20").alias("recall_20"), F.col("score").alias("anchor_score"), kind.alias("category"))
