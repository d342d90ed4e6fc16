"""Problem 8: a mix of sources in target shares of all tokens, small sources repeated at most so many times.

Method: weighted fair queueing. Each source's texts are shuffled by a hash; a text's virtual finish time is the number of its
source's tokens up to and with it, divided by the source's target share. Sorted by it over all sources, every prefix of the queue
holds the sources in their shares, so the queue is cut at the total budget. A source that runs out starts over, up to its number
of uses. The default budget is the largest one at which no source runs out of uses, so the scarcest source sets the size of the
mix; ``shares`` reports what part of the tokens held that is. A given budget is kept: beyond the default one exhausted sources fall
short, the others still get their part of it, and ``shares`` reports the shares reached.

The running sums are taken in two levels: over slices of each source's shuffled order, of bounded size, and over the slices'
totals, so a source with a third of all texts is no task of its own.

Texts without an id, a source or tokens, and sources without a target, take no part. A source with a target but without texts
can't hold a share; the others keep their proportions and the report shows 0 for it. Rows delivered twice under one id count
once, as the longest of them. Ties in the queue go by source and id. Empty tables yield no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.llm.tokens import TOKENIZER, sized
from claimloom.session import bounded, written


def _queue(docs: DataFrame, targets: DataFrame, budget: int | None, seed: int, tokenizer: str, slice_rows: int) -> tuple[DataFrame, DataFrame, float]:
    """The queue cut at the budget, the targets with what the sources hold, and the budget."""
    goal = targets.select("source", F.col("target_share").cast("double").alias("target_share"), F.coalesce(F.col("max_repeats"), F.lit(1)).alias("max_repeats")).where("source is not null and target_share > 0 and max_repeats >= 1").dropDuplicates(["source"])
    names = [r["source"] for r in bounded(goal.select("source"), 10_000, "sources with a target")]
    own = docs.where(F.col("source").isin(names)) if names else docs.where("false")
    texts = sized(own, tokenizer=tokenizer).where("n_tokens > 0").groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source")).alias("x")).select("doc_id", "x.source", "x.n_tokens")
    order = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 1)  # 63 bits
    texts = written(texts.withColumn("place", order), "shuffled-texts")
    held = texts.groupBy("source").agg(F.sum("n_tokens").alias("held"), F.count("*").alias("n"))
    known = {r["source"]: r for r in bounded(goal.join(held, "source", "left"), 10_000, "sources with a target")}
    live = {s: r for s, r in known.items() if r["held"]}
    scale = sum(r["target_share"] for r in live.values())
    most = min((r["held"] * r["max_repeats"] * scale / r["target_share"] for r in live.values()), default=0.0)
    total = float(budget) if budget is not None else most
    rows = sum(r["n"] for r in live.values())
    slices = max(1, -(-rows // slice_rows))
    part = F.floor(F.col("place") / F.lit(2.0**63 / slices))
    texts = texts.withColumn("slice", part)
    # level two: at most sources x slices rows
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = texts.groupBy("source", "slice").agg(F.sum("n_tokens").alias("t")).withColumn("earlier", F.coalesce(F.sum("t").over(before), F.lit(0))).drop("t")
    within = Window.partitionBy("source", "slice").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = texts.join(sums, ["source", "slice"]).withColumn("cum", F.col("earlier") + F.sum("n_tokens").over(within))
    weight = texts.sparkSession.createDataFrame([(s, r["target_share"] / scale, int(r["max_repeats"]), int(r["held"])) for s, r in live.items()], "source string, weight double, max_repeats int, held bigint")
    queue = cum.join(F.broadcast(weight), "source")  # a row a source with a target, bounded above
    last = F.floor((F.lit(total * (1 + 1e-12)) * F.col("weight") - F.col("cum")) / F.col("held"))
    queue = queue.where(last >= 0).withColumn("use", F.explode(F.sequence(F.lit(0), F.least(last, F.col("max_repeats") - 1).cast("int"))))
    queue = queue.withColumn("finish", (F.col("use") * F.col("held") + F.col("cum")) / F.col("weight"))
    return queue.select("source", "doc_id", "use", "n_tokens", "finish"), goal.join(held, "source", "left"), total


def mixed(docs: DataFrame, targets: DataFrame, *, budget: int | None = None, seed: int = 11, tokenizer: str = TOKENIZER, slice_rows: int = 50_000) -> DataFrame:
    """The selection in the order of the queue: ``doc_id``, ``use`` from 0, ``source``, ``n_tokens``, ``finish``."""
    queue, _, _ = _queue(docs, targets, budget, seed, tokenizer, slice_rows)
    return queue.select("doc_id", "use", "source", "n_tokens", "finish").orderBy("finish", "source", "doc_id")


def shares(docs: DataFrame, targets: DataFrame, *, budget: int | None = None, seed: int = 11, tokenizer: str = TOKENIZER, slice_rows: int = 50_000) -> DataFrame:
    """What the selection reaches, a row a source: target and reached share, tokens, uses and the most uses of one text; ``selected_part`` is the whole selection's tokens, repeats included, by the tokens that all sources with a target hold."""
    queue, goal, _ = _queue(docs, targets, budget, seed, tokenizer, slice_rows)
    got = queue.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_uses"), F.countDistinct("doc_id").alias("n_docs"), (F.max("use") + 1).alias("most_uses"))
    out = goal.join(got, "source", "left").na.fill(0, ["held", "n", "n_tokens", "n_uses", "n_docs", "most_uses"])
    every = Window.partitionBy()  # a row a source
    return out.select("source", "target_share", F.round(F.try_divide(F.col("n_tokens"), F.sum("n_tokens").over(every)), 6).alias("reached_share"), "n_tokens", "n_docs", "n_uses", "most_uses", "max_repeats", F.col("held").alias("tokens_held"), F.round(F.try_divide(F.sum("n_tokens").over(every), F.sum("held").over(every)), 6).alias("selected_part"))
