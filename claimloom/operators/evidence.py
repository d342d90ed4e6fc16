"""Sentences as evidence: candidates for results, claims by rules, and the best sentence for a claim."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom import lexicons as L
from claimloom.functions import text

#: Words that go with a claim's direction. Fixed values.
DIRECTION_WORDS = {
    "positive": ("beneficial", "decrease", "decreased", "decreases", "improve", "improved", "improves", "increase", "increased", "increases", "lower", "lowered", "reduce", "reduced", "reduces", "significant", "significantly"),
    "negative": ("adverse", "decrease", "decreased", "harmful", "increase", "increased", "increases", "risk", "worse", "worsen", "worsened"),
    "neutral": ("absence", "difference", "insignificant", "neutral", "none", "not", "significant", "significantly", "unchanged"),
}
METHOD_PHRASE = r"\b(?:aim|aimed|objective|objectives|purpose)\b|\b(?:study|trial)\s+(?:was\s+)?(?:designed|conducted)\s+to\b|\b(?:to|we)\s+(?:determine|evaluate|investigate)\b|\bwas\s+performed\b"
BROAD_SUBJECTS = ("food", "foods", "fermented", "probiotic", "probiotics", "yogurt", "kefir")


def result_sentences(articles: DataFrame, markers: Sequence[str] = L.RESULT_MARKERS) -> DataFrame:
    """``pmid``, ``pos``, ``sentence``: sentences of abstracts that bear a result."""
    s = articles.select("pmid", F.posexplode(text.sentences(F.col("abstract"))).alias("pos", "sentence"))
    return s.where(text.contains_any(F.lower("sentence"), markers))


def rule_claims(sentences: DataFrame, aliases: dict[str, Sequence[str]] = L.OUTCOME_ALIASES, subjects: Sequence[tuple[str, str]] = L.RETRY_SUBJECTS, *, most: int = 12) -> DataFrame:
    """Claims of result sentences by rules alone: a known subject phrase, every outcome whose alias occurs, the direction by cue words. Per article the first for each subject and outcome, ``most`` at most."""
    low = F.lower("sentence")
    subject = F.coalesce(*[F.when(F.contains(low, F.lit(p)), s) for p, s in subjects])
    s = sentences.where(~text.is_no_result(F.col("sentence"))).withColumn("subject", subject).where("subject is not null")
    names = list(aliases)
    met = F.array(*[F.when(text.contains_any(low, aliases[n]), F.struct(F.lit(i).alias("k"), F.lit(n).alias("outcome"))) for i, n in enumerate(names)])
    rows = s.withColumn("x", F.explode(F.array_compact(met))).select("pmid", "pos", "sentence", "subject", "x.k", "x.outcome")
    low = F.lower("sentence")
    effect = F.when(text.contains_any(low, L.NO_EFFECT_MARKERS), "no_significant_effect").when(text.contains_any(low, L.DECREASE_MARKERS), "decreased").when(text.contains_any(low, L.INCREASE_MARKERS), "increased").otherwise("changed")
    rows = rows.withColumn("effect_direction", effect)
    meant = text.inferred_health(F.col("effect_direction"), F.col("outcome"))
    rows = rows.withColumn("health_interpretation", F.when(F.col("effect_direction") == "no_significant_effect", "neutral").when(meant == "unclear", "beneficial").otherwise(meant))
    rows = rows.withColumn("direction", F.when(F.col("effect_direction") == "no_significant_effect", "neutral").when(F.col("health_interpretation") == "harmful", "negative").otherwise("positive"))
    rows = rows.withColumn("p_value", text.p_value(F.col("sentence")))
    keep = ["pos", "k", "sentence", "effect_direction", "health_interpretation", "direction", "p_value"]
    first = rows.groupBy("pmid", "subject", "outcome").agg(F.min(F.struct(*keep)).alias("x")).select("pmid", "subject", "outcome", "x.*")
    order = Window.partitionBy("pmid").orderBy("pos", "k")
    return first.withColumn("claim_ordinal", F.row_number().over(order)).where(F.col("claim_ordinal") <= most).drop("k")


def sentence_scores(pairs: DataFrame) -> DataFrame:
    """Score of a sentence as the evidence of a claim. ``pairs`` has sentence, subject, object, direction, effect_size and p_value; ``score`` is added."""
    w = text.content_words(F.col("sentence"))
    pairs = pairs.withColumns({"_w": w, "_s": text.content_words(F.col("subject")), "_o": text.content_words(F.col("object"))})
    common = lambda a, b: F.size(F.array_intersect(a, b))
    words = lambda x: F.array(*[F.lit(y) for y in x])
    toward = F.create_map(*[x for k, v in DIRECTION_WORDS.items() for x in (F.lit(k), words(v))])[F.col("direction")]
    claim = text.content_words(text.claim_text(F.col("subject"), F.col("object"), F.col("direction")))
    method, result = common(F.col("_w"), words(L.METHOD_CUES)), common(F.col("_w"), words(L.RESULT_CUES))
    low = F.lower("sentence")
    literal = sum((F.when((F.length(F.coalesce(c, F.lit(""))) > 0) & F.contains(low, F.lower(c)), 4.0).otherwise(0.0) for c in (F.col("p_value"),)), F.when((F.length(F.coalesce("effect_size", F.lit(""))) > 0) & F.contains(low, F.lower("effect_size")), 4.0).otherwise(0.0))
    broad = F.when((F.size("_s") > 0) & (common(F.col("_w"), F.col("_s")) == 0) & (common(F.col("_w"), words(BROAD_SUBJECTS)) > 0), 1.0).otherwise(0.0)
    penalty = F.when(low.rlike(METHOD_PHRASE), -25.0).when((method > 0) & (result == 0), -12.0).when(method > 0, -4.0).otherwise(0.0)
    score = common(F.col("_w"), F.col("_s")) * 4.0 + common(F.col("_w"), F.col("_o")) * 5.0 + common(F.col("_w"), claim) * 1.0 + F.least(F.coalesce(common(F.col("_w"), toward), F.lit(0)), F.lit(2)) * 0.5 + penalty + F.least(result, F.lit(3)) + literal + broad
    return pairs.withColumn("score", score).drop("_w", "_s", "_o")


def backfilled(claims: DataFrame, articles: DataFrame, *, least: float = 8.0) -> DataFrame:
    """The best sentence of the article for every claim record: ``ordinal``, ``snippet`` (empty below ``least``), ``score``. Equal scores go to the earlier sentence; records without a text yield no row."""
    cut = articles.select("pmid", F.posexplode(text.snippet_sentences(F.col("abstract"))).alias("pos", "sentence"))
    pairs = claims.select("ordinal", "pmid", "subject", "object", "direction", "effect_size", "p_value").join(cut, "pmid")
    best = sentence_scores(pairs).groupBy("ordinal").agg(F.max(F.struct("score", (-F.col("pos")).alias("p"), "sentence")).alias("b"))
    return best.select("ordinal", F.when(F.col("b.score") >= least, F.col("b.sentence")).otherwise("").alias("snippet"), F.col("b.score").alias("score"))
