"""Extracted claims: normalisation, rejection, merging into one row a claim, and claim confidence.

Order matters for what a merged claim takes from its first and last record, so every row carries an ordinal; results do not
depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import scoring, text


def once(df: DataFrame, **values: Column) -> DataFrame:
    """Add columns that are worked out once a row, whatever later filters and projections use them. A generator of one row keeps Catalyst from repeating their expressions in each use, which for these nested conditions would outgrow generated code."""
    kept = [c for c in df.columns if c not in values]
    return df.select(*kept, F.inline(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))))


def _given(claims: DataFrame, name: str) -> Column:
    """A column that not every source has."""
    return F.col(name).cast("string") if name in claims.columns else F.lit(None).cast("string")


def processed(claims: DataFrame, *, ordinal: str = "claim_row_id") -> DataFrame:
    """Normalised names, types, effect, health meaning and direction of every claim, its id, and why it is rejected (null: accepted). The first reason that applies is given.

    A finding without significant effect is neutral for health; where the meaning is unclear the one that effect and outcome imply is
    stored. A snippet that states an aim is a reason only where effect and meaning both stay unclear. A claim without a snippet has
    its key finding for one, if the table holds such a column.
    """
    name = lambda c: text.clean_format(F.lower(text.strip(F.coalesce(F.col(c), F.lit("")))))
    dose = F.col("dose_info") if "dose_info" in claims.columns else F.lit(None).cast("struct<value:string,unit:string,duration:string>")
    rows = claims.select(
        F.col(ordinal).alias("ordinal"), text.strip(F.col("pmid")).alias("pmid"), "subject_name", "object_name", F.col("subject_type").alias("given_type"), F.col("object_type").alias("given_object_type"), F.col("direction").alias("given_direction"),
        F.col("effect_direction").alias("given_effect"), F.col("health_interpretation").alias("given_health"), "effect_size", "p_value", "study_type", F.coalesce(F.nullif("evidence_snippet", F.lit("")), _given(claims, "key_finding"), F.lit("")).alias("evidence_snippet"),
        dose.alias("dose_info"), _given(claims, "confidence").alias("stated_confidence"), *[_given(claims, c).alias(c) for c in ("confidence_interval", "key_finding", "population")],
    )
    rows = once(
        rows,
        subject=name("subject_name"),
        object=name("object_name"),
        subject_type=text.subject_type(F.col("subject_name"), F.col("given_type")),
        object_type=F.when(text.norm(F.col("given_object_type")) == "", "outcome").otherwise(text.norm(F.col("given_object_type"))),
        effect_direction=text.effect_direction(F.col("given_effect")),
        given_health=text.health_interpretation(F.col("given_health")),
    )
    effect, given = F.col("effect_direction"), F.col("given_health")
    rows = once(rows, health_interpretation=F.when(effect == "no_significant_effect", "neutral").when(given == "unclear", text.inferred_health(effect, F.col("object"))).otherwise(given))
    rows = once(rows, direction=text.claim_direction(F.col("given_direction"), effect, F.col("health_interpretation"), F.lit("")))
    reason = (
        F.when(~F.col("subject_type").isin("food", "strain"), "subject type")
        .when((F.col("subject") == "") | (F.col("object") == ""), "no name")
        .when(~text.claim_in_scope(F.col("subject"), F.col("subject_type"), F.col("object")), "scope")
        .when((F.col("subject_type") == "food") & ~text.food_is_valid(F.col("subject")), "subject")
        .when((F.col("object_type") == "food") & ~text.food_is_valid(F.col("object")), "object")
        .when(F.col("direction") == "", "direction")
        .when((effect == "unclear") & (F.col("health_interpretation") == "unclear") & text.is_no_result(F.col("evidence_snippet")), "no result")
    )
    rows = once(rows, reject_reason=reason, claim_id=text.claim_id(F.col("subject"), F.col("object"), F.col("direction")))
    return rows.drop("subject_name", "object_name", "given_type", "given_object_type", "given_effect", "given_health")


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("reject_reason is null").drop("reject_reason")


def evidence(rows: DataFrame) -> DataFrame:
    """The evidence of the merged claims, a row each, keyed by ``claim_id`` and in the order of ``ordinal``; ``key`` says which record it came from. A table of its own, as a claim may hold any number of records."""
    key = F.concat_ws("_", "pmid", "ordinal")
    return rows.select("claim_id", "ordinal", "pmid", "study_type", "effect_size", "p_value", "confidence_interval", "key_finding", "evidence_snippet", "effect_direction", "health_interpretation", "population", F.coalesce("stated_confidence", F.lit("medium")).alias("confidence"), key.alias("key"))


def counted(rows: DataFrame) -> DataFrame:
    """Records counted by claim and article: what ``finished`` needs of them, and what can be added up batch by batch (``united``). Kinds of study are a vocabulary of a few words; their sets are what a row carries. A record without one counts as a kind of its own."""
    header = F.struct("subject", "subject_type", "object", "object_type", "direction", "effect_direction", "health_interpretation", "pmid", scoring.confidence_of_one(F.col("effect_size"), F.col("p_value"), F.col("study_type")).alias("one"), F.when(F.length(F.coalesce("dose_info.value", F.lit(""))) > 0, F.col("dose_info")).alias("dose_info"))
    stated = F.when(F.coalesce("effect_size", F.lit("")) != "", 0.1).otherwise(0.0) + F.when(F.coalesce("p_value", F.lit("")) != "", 0.1).otherwise(0.0)
    return rows.groupBy("claim_id", "pmid").agg(F.min("ordinal").alias("o"), F.max("ordinal").alias("last"), F.min_by(header, "ordinal").alias("h"), F.count("*").alias("n"), F.sum(stated).alias("s"), F.collect_set(F.lower(F.coalesce("study_type", F.lit("")))).alias("k"))


def united(parts: DataFrame) -> DataFrame:
    """Counts of several sets of records as those of all of them."""
    return parts.groupBy("claim_id", "pmid").agg(F.min("o").alias("o"), F.max("last").alias("last"), F.min_by("h", "o").alias("h"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.array_distinct(F.flatten(F.collect_set("k"))).alias("k"))


def finished(part: DataFrame) -> DataFrame:
    """One row a claim from counts by claim and article."""
    out = part.groupBy("claim_id").agg(
        F.min_by("h", "o").alias("h"), F.max_by("pmid", "last").alias("last_updated"), F.sum("n").alias("evidence_count"), F.count("pmid").alias("n_articles"), F.sum("s").alias("_s"),
        F.size(F.array_distinct(F.flatten(F.collect_set("k")))).alias("_kinds"),
    )
    many = F.least(0.5 + F.col("_s") / F.col("evidence_count") + F.least(F.col("evidence_count") * 0.1, F.lit(0.3)) + F.least(F.col("_kinds") * 0.05, F.lit(0.2)), F.lit(1.0))
    confidence = F.round(F.when(F.col("evidence_count") == 1, F.col("h.one")).otherwise(many), 6)
    fields = [F.col(f"h.{c}").alias(c) for c in ("subject", "subject_type", "object", "object_type", "direction", "effect_direction", "health_interpretation")]
    return out.select("claim_id", *fields, F.col("h.pmid").alias("first_seen"), "last_updated", "evidence_count", "n_articles", confidence.alias("confidence"), text.claim_text(F.col("h.subject"), F.col("h.object"), F.col("h.direction")).alias("claim_text"), F.col("h.dose_info").alias("dose_info"))


def merged(rows: DataFrame) -> DataFrame:
    """One row a claim id: header fields of its first record, the last pmid, and its confidence. ``evidence`` gives its records.

    Records are counted by claim and article first and by claim then, both partly before the shuffle, so no row is multiplied for
    distinct counts and a claim with a third of all records is spread over its articles.
    """
    return finished(counted(rows))


def heads(rows: DataFrame) -> DataFrame:
    """``claim_id``, ``subject``, ``object`` and ``claim_text`` of each merged claim, as ``merged`` has them, in one shuffle."""
    h = rows.groupBy("claim_id").agg(F.min_by(F.struct("subject", "object", "direction"), "ordinal").alias("h"))
    return h.select("claim_id", "h.subject", "h.object", text.claim_text(F.col("h.subject"), F.col("h.object"), F.col("h.direction")).alias("claim_text"))


def from_raw(claims: DataFrame) -> DataFrame:
    return merged(accepted(processed(claims)))


def first_pass(rows: DataFrame) -> DataFrame:
    """Of each article the accepted claims of the first ``pass`` that has any: what trying one after the other until one gives a claim keeps."""
    live = rows.where("reject_reason is null")
    return live.join(live.groupBy("pmid").agg(F.min("pass").alias("_p")), "pmid").where("pass = _p").drop("_p")


def canonical_names(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """Subjects and objects under the name that the article's own entities have for them, whatever the type; of several entities with an alias the first counts. Names no entity has stay."""
    key = lambda c: text.clean_format(F.lower(text.strip(F.coalesce(c, F.lit("")))))
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    e = entities.select(text.strip(F.col("pmid")).alias("pmid"), "entity_id", key(F.col("name")).alias("canonical"), F.explode(names).alias("alias")).where("alias is not null and canonical <> ''")
    known = e.withColumn("alias", key(F.col("alias"))).where("alias <> ''").groupBy("pmid", "alias").agg(F.min_by("canonical", "entity_id").alias("canonical"))
    for c in ("subject", "object"):
        side = known.select("pmid", F.col("alias").alias(c), F.col("canonical").alias("_c"))
        rows = rows.join(side, ["pmid", c], "left").withColumn(c, F.coalesce("_c", c)).drop("_c")
    return rows


def with_snippets(evidence: DataFrame, best: DataFrame) -> DataFrame:
    """Evidence whose empty snippets are filled with the best sentence found for the record (``ordinal``, ``snippet``); ``backfilled`` says where."""
    j = evidence.join(best.select("ordinal", "snippet"), "ordinal", "left")
    fill = (F.length(F.trim(F.coalesce("evidence_snippet", F.lit("")))) == 0) & (F.length(F.coalesce("snippet", F.lit(""))) > 0)
    return j.withColumns({"backfilled": fill, "evidence_snippet": F.when(fill, F.col("snippet")).otherwise(F.col("evidence_snippet"))}).drop("snippet")


def sampled(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows in the order of a hash of their key: a random sample that is the same for every partitioning."""
    return rows.orderBy(F.md5(F.concat(F.lit(seed + "|"), F.col(key).cast("string"))), key).limit(n)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: what reading keyed records one after the other would keep."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in df.columns if c not in keys]), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def most_common(df: DataFrame, column: str, ordinal: str, n: int) -> DataFrame:
    """The n most frequent values; equally frequent ones by first appearance."""
    return df.groupBy(column).agg(F.count("*").alias("n"), F.min(ordinal).alias("first")).orderBy(F.desc("n"), "first").limit(n)
