"""Articles: resolution of texts, journals, and scores of papers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom import lexicons as L
from claimloom.functions import scoring, text
from claimloom.operators.graph import contained_names


def latest_articles(articles: DataFrame) -> DataFrame:
    """One row a trimmed pmid, the one fetched last."""
    from claimloom.operators.claims import latest

    rows = articles.withColumn("pmid", text.strip(F.col("pmid"))).where("pmid <> ''")
    return latest(rows, ["pmid"], [F.col("fetched_at"), F.xxhash64("title", "abstract")])


def resolved(selected: DataFrame, metadata: DataFrame, *, factor: float = 1.25) -> DataFrame:
    """Title and abstract for every selected article: the metadata's, unless it has no text or the selected text is longer by more than the factor."""
    clean = lambda c: text.strip(F.coalesce(F.col(c), F.lit("")))
    s = selected.select(text.strip(F.col("pmid")).alias("pmid"), clean("title").alias("s_title"), clean("abstract").alias("s_abstract"))
    m = metadata.select("pmid", clean("title").alias("m_title"), clean("abstract").alias("m_abstract"), F.lit(True).alias("known"))
    j = s.join(m, "pmid", "left")
    own = (F.length("s_abstract") > 0) & ((F.length(F.coalesce("m_abstract", F.lit(""))) == 0) | (F.length("s_abstract") > F.length("m_abstract") * factor))
    return j.where("known or length(s_abstract) > 0").select(
        "pmid",
        F.when(F.coalesce("m_title", F.lit("")) != "", F.col("m_title")).otherwise(F.col("s_title")).alias("title"),
        F.when(own, F.col("s_abstract")).otherwise(F.coalesce("m_abstract", F.lit(""))).alias("abstract"),
        F.when(own, "selected").otherwise("metadata").alias("text_source"),
    )


def paper_scores(articles: DataFrame, institutions: Sequence[str], funders: dict[str, Sequence[str]], journals: DataFrame) -> DataFrame:
    """Study type, sample size, journal, institution and funding scores of every article, their weighted sum and its grade.

    ``institutions`` are names that count when an affiliation contains one; ``funders`` lists keywords of government, non_profit,
    industry and academic agencies.
    """
    types, title, abstract = F.col("publication_types"), F.col("title"), F.col("abstract")
    names = F.lower(F.array_join(scoring.type_names(types), "\n"))
    study = scoring.study_ladder(types)
    n = scoring.sample_size(title, abstract)
    trial_like = names.rlike("randomized|meta-analysis|systematic review")
    affil = F.flatten(F.transform(F.coalesce("authors_full", F.array().cast(articles.schema["authors_full"].dataType)), lambda a: F.coalesce(a["affiliations"], F.array().cast("array<string>"))))
    affil = F.when(F.size(affil) > 0, affil).otherwise(F.coalesce("author_affiliations", F.array().cast("array<string>")))
    hits = F.size(F.filter(affil, lambda a: text.contains_any(F.lower(F.coalesce(a, F.lit(""))), [i.lower() for i in institutions])))
    known = F.when(F.size(affil) == 0, 0.0).otherwise(scoring.rung(hits, [(5, 10.0), (3, 9.0), (2, 8.0), (1, 6.0)], 3.0))
    agencies = F.transform(F.coalesce("grants", F.array().cast(articles.schema["grants"].dataType)), lambda g: F.lower(F.coalesce(g["agency"], F.lit(""))))
    naming = lambda words: lambda a: text.contains_any(a, [x.lower() for x in words])
    count = {k: F.size(F.filter(agencies, naming(v))) for k, v in funders.items()}
    kind = (
        F.when(F.size(agencies) == 0, "none")
        .when((count["industry"] > 0) & ((count["government"] > 0) | (count["non_profit"] > 0)), "mixed")
        .when(count["industry"] > 0, "industry")
        .when(count["government"] > 0, "government")
        .when(count["non_profit"] > 0, "non_profit")
        .when(count["academic"] > 0, "academic")
        .otherwise("unknown")
    )
    points = F.create_map(*[F.lit(x) for kv in {"none": 5.0, "mixed": 6.0, "industry": 3.0, "government": 10.0, "non_profit": 8.0, "academic": 7.0, "unknown": 5.0}.items() for x in kv])
    rows = articles.select("pmid", study["score"].alias("study_score"), study["label"].alias("study_label"), n.alias("sample_size"), scoring.sample_score(n, trial_like).alias("sample_score"), known.alias("institution_score"), kind.alias("funding"))
    rows = rows.withColumn("funding_score", points[F.col("funding")]).join(journal_scores(articles, journals), "pmid")
    total = F.round(F.col("study_score") * 0.25 + F.col("sample_score") * 0.2 + F.col("journal_score") * 0.2 + F.col("institution_score") * 0.15 + F.col("funding_score") * 0.2, 6)
    return rows.withColumn("total", total).withColumn("grade", scoring.grade(F.col("total")))


def rule_scores(articles: DataFrame, full_text: DataFrame) -> DataFrame:
    """Design, outcome, sample and relevance scores by rules, with 10 % for having a full text."""
    held = full_text.select(text.strip(F.col("pmid")).alias("pmid"), F.lit(True).alias("has_full_text")).distinct()
    a = articles.join(held, "pmid", "left")
    rows = a.select(
        "pmid",
        scoring.rule_design(F.col("publication_types"), F.col("title"), F.col("abstract")).alias("study_design"),
        scoring.rule_outcome(F.col("title"), F.col("abstract")).alias("outcome_clarity"),
        scoring.rule_sample(F.col("abstract")).alias("sample"),
        scoring.relevance(F.col("title"), F.col("abstract"), F.col("mesh_terms"), F.col("keywords")).alias("relevance"),
        F.coalesce("has_full_text", F.lit(False)).alias("has_full_text"),
    )
    overall = F.col("study_design") * 0.4 + F.col("outcome_clarity") * 0.3 + F.col("sample") * 0.2 + F.when(F.col("has_full_text"), 100.0).otherwise(0.0) * 0.1
    return rows.withColumn("overall", F.round(overall, 2))


def expansion(articles: DataFrame, scored: DataFrame) -> DataFrame:
    """Score of an article as an addition to the corpus, and the reasons, in order."""
    a = articles.join(scored.select("pmid", "overall", "study_design"), "pmid")
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    mesh = F.lower(F.array_join(F.coalesce("mesh_terms", F.array().cast("array<string>")), " "))
    body = F.concat(low("title"), F.lit(" "), low("abstract"), F.lit(" "), mesh)
    types = F.lower(F.array_join(scoring.type_names(F.col("publication_types")), " "))
    review = F.concat(types, F.lit(" "), low("title")).rlike("review|meta-analysis")
    trial = F.concat(types, F.lit(" "), low("title"), F.lit(" "), low("abstract")).rlike("clinical trial|randomized|randomised|crossover")
    a = a.withColumns({"_d": F.size(scoring.found_terms(body, L.DOMAIN_TERMS)), "_t": F.size(scoring.found_terms(low("title"), L.DOMAIN_TERMS)), "_o": F.size(scoring.found_terms(body, L.OUTCOME_TERMS)), "_x": F.array_sort(scoring.found_terms(body, L.EXCLUDED_TERMS)), "_r": review, "_c": trial, "_p": F.length(F.coalesce("pmcid", F.lit(""))) > 0})
    add = lambda c, n: F.when(c, F.lit(float(n))).otherwise(F.lit(0.0))
    r, p = F.col("_r"), F.col("_p")
    score = (
        F.col("overall") + F.least("_d", F.lit(5)) * 3 + F.least("_t", F.lit(3)) * 5 + F.least("_o", F.lit(5)) * 2 + add(F.col("_c"), 18) + add(r, 6) + add(r & p, 8) + add(p & ~r, 3)
        + add(F.length(F.coalesce("abstract", F.lit(""))) > 0, 2) - add(F.size("_x") > 0, 25) - add(F.col("_d") == 0, 50) - add(r & ~p, 8)
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.col("_c"), "clinical_trial_or_rct"), F.when(r, "review"), F.when(r & p, "review_with_pmc_fulltext"), F.when(p & ~r, "has_pmcid"), F.when(F.col("_t") > 0, "domain_term_in_title"),
            F.when(F.col("_o") > 0, "health_outcome_terms"), F.when(F.size("_x") > 0, F.concat(F.lit("excluded_context:"), F.array_join(F.slice("_x", 1, 3), ","))), F.when(F.col("_d") == 0, "no_domain_term"),
            F.when(r & ~p, "review_abstract_only"),
        )
    )
    return a.select("pmid", F.round(score, 2).alias("score"), F.array_join(reasons, ";").alias("reasons"))


def journal_match(names: DataFrame, journals: DataFrame) -> DataFrame:
    """For every journal name its entry of a list: the same name, else the first in the list's order that contains it or is contained in it, else the first that contains what is left of the name without its filling words.

    ``names`` has journal; ``journals`` has title and ordinal. Only distinct names take part. Names meet titles on their rarest
    three characters, so neither side is compared as a whole with the other.
    """
    n = names.select(F.lower(text.strip(F.col("journal"))).alias("journal")).where("journal <> ''").distinct()
    j = journals.select(F.lower(text.strip(F.col("title"))).alias("title"), "ordinal").where("title <> ''").groupBy("title").agg(F.min("ordinal").alias("ordinal"))
    exact = n.join(j, n["journal"] == j["title"]).select("journal", "title", F.lit("exact").alias("how"))
    words = F.col("journal")
    for w in ("journal", "of", "and", "the"):
        words = F.replace(words, F.lit(w), F.lit(""))
    rest = n.join(exact.select("journal"), "journal", "left_anti").withColumn("words", text.strip(words))
    pool = rest.select(F.explode(F.array("journal", "words")).alias("name")).unionByName(j.select(F.col("title").alias("name"))).where("name <> ''").distinct().withColumn("entity_type", F.lit("journal"))
    pairs = contained_names(pool)
    pairs = pairs.select(F.explode(F.array(F.struct(F.col("entity_a").alias("a"), F.col("entity_b").alias("title")), F.struct(F.col("entity_b").alias("a"), F.col("entity_a").alias("title")))).alias("p")).select("p.*").join(j, "title")
    part = rest.join(pairs, rest["journal"] == pairs["a"]).groupBy("journal").agg(F.min_by("title", "ordinal").alias("title")).withColumn("how", F.lit("contained"))
    left = rest.where("words <> ''").join(part.select("journal"), "journal", "left_anti")
    inner = pairs.where(F.contains("title", "a")).select(F.col("a").alias("words"), "title", "ordinal").unionByName(j.select(F.col("title").alias("words"), "title", "ordinal"))
    by_words = left.join(inner, "words").groupBy("journal").agg(F.min_by("title", "ordinal").alias("title")).withColumn("how", F.lit("words"))
    found = exact.unionByName(part).unionByName(by_words)
    return n.join(found, "journal", "left").withColumn("how", F.coalesce("how", F.lit("none")))


def journal_tier(sjr: Column, ranked: Column) -> Column:
    """Score and tier of a journal by its rank indicator; ``ranked`` says whether the list has the journal."""
    steps = ((10.0, 10.0, "top"), (5.0, 9.0, "excellent"), (3.0, 8.0, "high"), (2.0, 7.0, "good"), (1.0, 6.0, "medium"), (0.5, 5.0, "fair"))
    pair = lambda s, t: F.struct(F.lit(s).alias("score"), F.lit(t).alias("tier"))
    out = F.when(~ranked, pair(3.0, "unranked"))
    for low, score, tier in steps:
        out = out.when(sjr >= low, pair(score, tier))
    return out.when(sjr > 0, pair(4.0, "low")).otherwise(pair(3.0, "unranked"))


def journal_scores(articles: DataFrame, journals: DataFrame) -> DataFrame:
    """``pmid``, ``journal_score``, ``journal_tier`` of every article; ``journals`` has title, ordinal and sjr. Without a journal 0, unknown."""
    key = F.lower(text.strip(F.coalesce("journal", F.lit(""))))
    sjr = journals.groupBy(F.lower(text.strip(F.col("title"))).alias("title")).agg(F.min_by("sjr", "ordinal").alias("sjr"))
    known = journal_match(articles.select("journal"), journals).join(sjr, "title", "left").select(F.col("journal").alias("_j"), "sjr")
    j = articles.select("pmid", key.alias("_j")).join(known, "_j", "left")
    tier = F.when(F.col("_j") == "", F.struct(F.lit(0.0).alias("score"), F.lit("unknown").alias("tier"))).otherwise(journal_tier(F.coalesce("sjr", F.lit(0.0)), F.col("sjr").isNotNull()))
    return j.select("pmid", tier["score"].alias("journal_score"), tier["tier"].alias("journal_tier"))


def detected_types(articles: DataFrame) -> DataFrame:
    """``pmid`` and the coarse study type its publication types name."""
    t = F.lower(F.array_join(scoring.type_names(F.col("publication_types")), "\n"))
    kind = F.when(t.contains("randomized"), "RCT").when(t.contains("meta-analysis"), "Meta-analysis").when(t.contains("systematic review"), "Systematic review").otherwise("Other")
    return articles.select("pmid", kind.alias("study_type"))


def worth_retrying(articles: DataFrame, *, out: Sequence[str] = L.OUT_OF_SCOPE_SUBJECTS, within: Sequence[str] = L.IN_SCOPE_SUBJECTS) -> DataFrame:
    """Articles that name a subject in scope and none out of it, in title or abstract: another pass may find claims the first did not."""
    t = text.norm(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))))
    return articles.where(~text.contains_any(t, out) & text.contains_any(t, within))


def evidence_of(c: Column) -> Column:
    """Whether a text has a p-value, a confidence interval or a sample size."""
    return text.p_value(c).isNotNull() | c.rlike(r"(?i)95%\s*CI") | text.first_sample(c).isNotNull()
