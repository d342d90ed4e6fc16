"""Ladders and weighted sums over article and claim columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom import lexicons as L
from claimloom.functions.text import contains_any, first_sample, largest_sample


def type_names(types: Column) -> Column:
    return F.transform(F.coalesce(types, F.array().cast("array<struct<name:string>>")), lambda t: F.coalesce(t["name"], F.lit("")))


def study_ladder(types: Column) -> Column:
    """Score and label of the first publication type marker that applies."""
    low = F.array_join(F.transform(type_names(types), lambda x: F.lower(x)), "\n")
    pair = lambda s, name: F.struct(F.lit(s).alias("score"), F.lit(name).alias("label"))
    out = reduce(lambda a, x: a.when(low.contains(x[0]), pair(x[1], x[2])), L.STUDY_LADDER[1:], F.when(low.contains(L.STUDY_LADDER[0][0]), pair(*L.STUDY_LADDER[0][1:])))
    return out.otherwise(pair(0.0, "Unknown"))


def rung(c: Column, steps: Sequence[tuple[float, float]], low: float) -> Column:
    """The value of the highest step reached."""
    out = reduce(lambda a, x: a.when(c >= x[0], F.lit(x[1])), steps[1:], F.when(c >= steps[0][0], F.lit(steps[0][1])))
    return out.otherwise(F.lit(low))


def sample_score(n: Column, trial_like: Column) -> Column:
    trial = rung(n, [(1000, 10.0), (500, 9.0), (200, 8.0), (100, 7.0), (50, 5.0), (1, 3.0)], 0.0)
    other = rung(n, [(500, 10.0), (200, 8.0), (100, 7.0), (50, 5.0), (1, 3.0)], 0.0)
    return F.when(trial_like, trial).otherwise(other)


def sample_size(title: Column, abstract: Column) -> Column:
    return largest_sample(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(abstract, F.lit(""))))


def grade(score: Column) -> Column:
    steps = [(9.0, "A+"), (8.5, "A"), (8.0, "A-"), (7.5, "B+"), (7.0, "B"), (6.5, "B-"), (6.0, "C+"), (5.5, "C"), (5.0, "C-"), (3.0, "D")]
    return reduce(lambda a, x: a.when(score >= x[0], x[1]), steps[1:], F.when(score >= steps[0][0], steps[0][1])).otherwise("F")


def rule_design(types: Column, title: Column, abstract: Column) -> Column:
    names, t, a = type_names(types), F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(abstract, F.lit("")))
    has = lambda *x: F.arrays_overlap(names, F.array(*[F.lit(y) for y in x]))
    rct = has("Randomized Controlled Trial", "Clinical Trial") | t.rlike("randomized|randomised") | a.rlike("double-blind|placebo-controlled")
    meta = has("Meta-Analysis", "Review", "Systematic Review") | t.rlike("meta-analysis|systematic review")
    return F.when(rct, 100.0).when(t.rlike("crossover|cross-over"), 90.0).when(has("Cohort"), 70.0).when(has("Case-Control"), 50.0).when(meta, 30.0).otherwise(40.0)


def rule_outcome(title: Column, abstract: Column) -> Column:
    t = F.lower(F.concat_ws("\n", F.coalesce(abstract, F.lit("")), F.coalesce(title, F.lit(""))))
    metabolic, gut, numbers = contains_any(t, L.METABOLIC_TERMS), contains_any(t, L.GUT_TERMS), F.coalesce(abstract, F.lit("")).rlike(r"\d")
    return F.when(metabolic & numbers, 100.0).when(metabolic, 80.0).when(gut & numbers, 75.0).when(gut, 60.0).otherwise(40.0)


def rule_sample(abstract: Column) -> Column:
    n = first_sample(F.coalesce(abstract, F.lit("")))
    return F.when(n.isNull(), 50.0).otherwise(rung(n, [(100, 100.0), (50, 80.0), (20, 60.0)], 40.0))


def found_terms(text: Column, terms: Sequence[str]) -> Column:
    """The terms a text contains, in the order of the list."""
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t))


def relevance(title: Column, abstract: Column, mesh: Column, keywords: Column) -> Column:
    words = F.concat(F.coalesce(mesh, F.array().cast("array<string>")), F.coalesce(keywords, F.array().cast("array<string>")))
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(abstract, F.lit("")), F.lit(" "), F.array_join(words, " ")))
    n, rct = F.size(found_terms(text, L.FERMENTED_TERMS)), text.rlike("randomized|clinical trial")
    return F.when((n >= 2) & rct, 5.0).when((n >= 1) & rct, 4.0).when(n >= 2, 3.0).when(n >= 1, 2.0).otherwise(1.0)


def confidence_of_one(effect: Column, p: Column, study: Column) -> Column:
    """Of a claim with one piece of evidence."""
    s, v = F.lower(F.coalesce(study, F.lit(""))), F.coalesce(p, F.lit(""))
    total = F.lit(0.5) + F.when(F.coalesce(effect, F.lit("")) != "", 0.1).otherwise(0.0) + F.when(v.contains("<0.01") | v.contains("<0.05"), 0.1).otherwise(0.0)
    return F.least(total + F.when(s.contains("rct") | s.contains("meta"), 0.2).when(s.contains("review"), 0.1).otherwise(0.0), F.lit(1.0))
