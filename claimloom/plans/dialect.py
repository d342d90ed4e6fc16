"""The oracle's side of the queries: DuckDB SQL for the steps that several of them share, written independently of the DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from claimloom import lexicons as L

_ENDS = r"^[\s\x{a0}]+|[\s\x{a0}]+$"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '{_ENDS}', '', 'g')"


def norm(x: str) -> str:
    return f"translate(lower({strip(f'coalesce({x}, {quoted(str())})')}), ' -', '__')"


def any_of(x: str, terms: Sequence[str]) -> str:
    pattern = "|".join("".join("\\" + c if c in r"\.[]{}()*+?^$|" else c for c in t) for t in terms)
    return f"regexp_matches({x}, {quoted(pattern)})"


def among(x: str, terms: Sequence[str]) -> str:
    return f"{x} in ({', '.join(quoted(t) for t in terms)})"


def mapped(x: str, table: dict[str, Sequence[str]], other: str) -> str:
    return "case " + " ".join(f"when {among(x, v)} then {quoted(k)}" for k, v in table.items()) + f" else {other} end"


def effect(x: str) -> str:
    return mapped(norm(x), L.EFFECT_SYNONYMS, f"case when {among(norm(x), L.EFFECT_DIRECTIONS)} then {norm(x)} else 'unclear' end")


def health(x: str) -> str:
    return mapped(norm(x), L.HEALTH_SYNONYMS, f"case when {among(norm(x), L.HEALTH_INTERPRETATIONS)} then {norm(x)} else 'unclear' end")


def inferred(eff: str, outcome: str) -> str:
    o = norm(outcome)
    bad, good = any_of(o, L.ADVERSE_OUTCOMES), any_of(o, L.BENEFICIAL_OUTCOMES)
    return (
        f"case when {eff} = 'no_significant_effect' then 'neutral' when {bad} and {eff} = 'decreased' then 'beneficial' when {bad} and {eff} = 'increased' then 'harmful' "
        f"when {good} and {eff} = 'increased' then 'beneficial' when {good} and {eff} = 'decreased' then 'harmful' else 'unclear' end"
    )


def clean(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '(?:[\s\x{{a0}}]|_)+', '_', 'g'), '^_+|_+$', '', 'g')"


def name(x: str) -> str:
    empty = "''"
    return clean(f"lower({strip(f'coalesce({x}, {empty})')})")


def subject_type() -> str:
    s, k = norm("subject_name"), norm("subject_type")
    compound = any_of(s, L.COMPOUND_MARKERS)
    prefixed = f"regexp_matches({s}, '^(?:{'|'.join(L.STRAIN_PREFIXES)})')"
    return (
        f"case when {prefixed} and not {compound} then 'strain' when {k} = 'strain' and {compound} then 'food' when {k} in ('strain', 'food') then {k} "
        f"when {among(k, L.INTERVENTION_TYPES)} then 'food' when {any_of(s, L.IN_SCOPE_SUBJECTS)} then 'food' when {k} <> '' then {k} else 'food' end"
    )


def bad_food(x: str) -> str:
    spaced = f"replace({x}, '_', ' ')"
    patterns = [f"regexp_matches({y}, {quoted('(?i)' + p)})" for p in L.INVALID_FOOD_PATTERNS for y in (x, spaced)]
    return f"({among(x, L.INVALID_FOODS)} or {among(spaced, L.INVALID_FOODS)} or length({x}) <= 2 or {' or '.join(patterns)})"


def processed() -> str:
    """CTEs up to ``p``: every claim record normalised, with direction, reject reason and claim id."""
    scope = f"not {any_of(norm('subject'), L.OUT_OF_SCOPE_SUBJECTS)} and (stype = 'strain' or {any_of(norm('subject'), L.IN_SCOPE_SUBJECTS)}) and not {any_of(norm('object'), L.OUT_OF_SCOPE_OUTCOMES)}"
    return f"""
    p0 as (select claim_row_id as ordinal, {strip('pmid')} as pmid, {name('subject_name')} as subject, {name('object_name')} as object, {subject_type()} as stype,
             case when {norm('object_type')} = '' then 'outcome' else {norm('object_type')} end as otype, direction as given, {effect('effect_direction')} as eff,
             {health('health_interpretation')} as said, effect_size, p_value, study_type, coalesce(evidence_snippet, '') as evidence_snippet, dose_info, coalesce(confidence, 'medium') as stated from extracted_claims),
    p1 as (select *, case when eff = 'no_significant_effect' then 'neutral' when said = 'unclear' then {inferred('eff', 'object')} else said end as hi from p0),
    p2 as (select *, case hi when 'neutral' then 'neutral' when 'beneficial' then 'positive' when 'harmful' then 'negative' else {mapped(norm('given'), L.DIRECTION_SYNONYMS, quoted(''))} end as direction from p1),
    p as (select *, case when stype not in ('food', 'strain') then 'subject type' when subject = '' or object = '' then 'no name' when not ({scope}) then 'scope'
             when stype = 'food' and {bad_food('subject')} then 'subject' when otype = 'food' and {bad_food('object')} then 'object' when direction = '' then 'direction'
             when eff = 'unclear' and hi = 'unclear' and {any_of("lower(evidence_snippet)", L.NON_RESULT_PHRASES)} then 'no result' end as reason,
             substr(md5(lower(subject) || '|' || lower(object) || '|' || direction), 1, 12) as claim_id from p2),
    a as (select * from p where reason is null)"""


def merged(source: str = "a", out: str = "m") -> str:
    """CTE ``m``: one row a claim id."""
    one = (
        "least(0.5::double + case when coalesce(effect_size, '') <> '' then 0.1::double else 0 end + case when contains(coalesce(p_value, ''), '<0.01') or contains(coalesce(p_value, ''), '<0.05') then 0.1::double else 0 end "
        "+ case when contains(lower(coalesce(study_type, '')), 'rct') or contains(lower(coalesce(study_type, '')), 'meta') then 0.2::double when contains(lower(coalesce(study_type, '')), 'review') then 0.1::double else 0 end, 1.0::double)"
    )
    base = "avg(0.5::double + case when coalesce(effect_size, '') <> '' then 0.1::double else 0 end + case when coalesce(p_value, '') <> '' then 0.1::double else 0 end)"
    many = f"least({base} + least(count(*) * 0.1::double, 0.3::double) + least(count(distinct lower(coalesce(study_type, ''))) * 0.05::double, 0.2::double), 1.0::double)"
    return f"""
    {out} as (select claim_id, arg_min(subject, ordinal) as subject, arg_min(stype, ordinal) as subject_type, arg_min(object, ordinal) as object, arg_min(otype, ordinal) as object_type,
             arg_min(direction, ordinal) as direction, arg_min(eff, ordinal) as effect_direction, arg_min(hi, ordinal) as health_interpretation, arg_min(pmid, ordinal) as first_seen,
             arg_max(pmid, ordinal) as last_updated, count(*) as evidence_count, count(distinct pmid) as n_articles,
             round(case when count(*) = 1 then arg_min({one}, ordinal) else {many} end, 6) as confidence from {source} group by claim_id)"""


def with_merged(query: str) -> str:
    return f"with {processed()}, {merged()} {query}"


def bag(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+')"
