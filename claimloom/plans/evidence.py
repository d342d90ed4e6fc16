"""Queries over the evidence tables, each with the SQL it must equal where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom import lexicons as L
from claimloom.functions import scoring, text, vectors
from claimloom.operators import audit, benchmarks, claims, corpus, entities, evidence, graph, quality, retrieval, summaries, transcripts
from claimloom.plans import dialect as D
from claimloom.session import spread, written
from claimloom.streaming import incremental

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _rows(spark, sf) -> DataFrame:
    return claims.processed(spread(_t(spark, sf, "extracted_claims")))


def _merged(spark, sf) -> DataFrame:
    return claims.merged(claims.accepted(_rows(spark, sf)))


# claims ----------------------------------------------------------------------------------------------------------------------


@query(f"with {D.processed()} select ordinal, pmid, subject, object, stype as subject_type, otype as object_type, eff as effect_direction, hi as health_interpretation, direction, reason as reject_reason, claim_id from p")
def claims_processed(spark, sf):
    return _rows(spark, sf).select("ordinal", "pmid", "subject", "object", "subject_type", "object_type", "effect_direction", "health_interpretation", "direction", "reject_reason", "claim_id")


@query(f"with {D.processed()} select coalesce(reason, 'accepted') as reason, count(*) as n, count(distinct pmid) as n_articles from p group by 1")
def claims_reject_reasons(spark, sf):
    return _rows(spark, sf).groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"), F.countDistinct("pmid").alias("n_articles"))


@query(D.with_merged("select *, subject || ' has ' || direction || ' effect on ' || object as claim_text from m"))
def claims_merged(spark, sf):
    return _merged(spark, sf).drop("dose_info")


@query(
    f"with {D.processed()} select claim_id, ordinal, pmid, study_type, effect_size, p_value, evidence_snippet, eff as effect_direction, hi as health_interpretation, stated as confidence, concat_ws('_', pmid, ordinal) as key from a"
)
def claims_evidence(spark, sf):
    return claims.evidence(claims.accepted(_rows(spark, sf))).drop("confidence_interval", "key_finding", "population")


@query(f"with {D.processed()} select claim_id, arg_min(nullif(coalesce(dose_info.value, ''), ''), ordinal) filter (where ordinal = first) as dose, count(*) as n from (select *, min(ordinal) over (partition by claim_id) as first from a) group by claim_id")
def claims_doses(spark, sf):
    """The dose a claim has from its first record."""
    return _merged(spark, sf).select("claim_id", F.col("dose_info.value").alias("dose"), F.col("evidence_count").alias("n"))


@query(f"with {D.processed()} select object as outcome, count(*) as n, min(ordinal) as first from a group by 1 order by n desc, first limit 10")
def claims_most_common(spark, sf):
    return claims.most_common(claims.accepted(_rows(spark, sf)).withColumnRenamed("object", "outcome"), "outcome", "ordinal", 10)


@query(
    "with c as (select claim_row_id, lower(regexp_replace(coalesce(subject_name, ''), '^[\\s\\x{a0}]+|[\\s\\x{a0}]+$', '', 'g')) as s from extracted_claims) select claim_row_id, "
    "(length(s) - length(replace(s, '_', '')) >= 4 or regexp_matches(s, '\\p{Nd}')) as over_specific, (" + " or ".join(f"regexp_matches(s, {D.quoted(p)})" for p in L.SUSPICIOUS_FOOD_PATTERNS) + ") as suspicious from c"
)
def names_flags(spark, sf):
    c = F.col("subject_name")
    return _t(spark, sf, "extracted_claims").select("claim_row_id", text.is_over_specific(c).alias("over_specific"), text.is_suspicious_food(c).alias("suspicious"))


def _food_sql() -> str:
    s = D.strip("coalesce(subject_name, '')")
    steps = [f"s0 as (select claim_row_id, lower({s}) as s from extracted_claims)"]
    for i, (a, b) in enumerate(L.FOOD_SYNONYMS):
        steps.append(f"s{i + 1} as (select claim_row_id, case when s = '{a}' or starts_with(s, '{a} ') then '{b}' || substr(s, {len(a) + 1}) else s end as s from s{i})")
    n = len(L.FOOD_SYNONYMS)
    k71 = "heat-killed lactobacillus paracasei k71"
    for e in (
        r"regexp_replace(s, '\s*\(?3\.25%\s*fat\)?', '', 'g')", r"regexp_replace(s, '\s*\((?:dy|dcy|py)\)\s*$', '')", "replace(s, 'vitamin d + calcium-fortified yogurt drink', 'vitamin d calcium fortified yogurt drink')",
        "replace(s, 'vitamin d- or vitamin d + calcium-fortified yogurt drink', 'vitamin d fortified yogurt drink')", f"case when contains(s, '{k71}') or s in ('lab diet', 'lab diet group') then '{k71} supplement' else s end",
        r"case when contains(s, 'greek yogurt') and regexp_matches(s, 'exercise|training|\+') then 'greek yogurt' else s end",
        "case when contains(s, 'lactobacillus rhamnosus gr-1') and regexp_matches(s, 'yogurt|yoghurt') then 'probiotic yogurt' else s end", "case when regexp_matches(s, '^probiotic[_ ]yogurt containing') then 'probiotic yogurt' else s end",
        "case when contains(s, 'bacillus coagulans') and contains(s, 'inulin') then 'synbiotic supplement' else s end", "case when contains(s, 'with greek yogurt') or contains(s, 'greek yogurt consumption') then 'greek yogurt' else s end",
        "case when regexp_matches(s, '^(?:combination of bifidobacterium|multi-strain probiotic|multi-strain combination)') then 'multi strain probiotic formulation' else s end",
        "case when starts_with(s, 'yogurt containing') then 'probiotic yogurt' when starts_with(s, 'yeast containing saccharomyces cerevisiae') then 'saccharomyces cerevisiae yeast' else replace(s, 'probiotic/synbiotic', 'probiotic synbiotic') end",
    ):
        steps.append(f"s{n + 1} as (select claim_row_id, {e} as s from s{n})")
        n += 1
    return f"with {', '.join(steps)}, f as (select claim_row_id, {D.clean('s')} as food from s{n}) select claim_row_id, food, not {D.bad_food('food')} as is_valid from f"


@query(_food_sql())
def names_food(spark, sf):
    rows = _t(spark, sf, "extracted_claims").select("claim_row_id", text.food_name(F.col("subject_name")).alias("food"))
    return rows.withColumn("is_valid", text.food_is_valid(F.col("food")))


def _strain_sql() -> str:
    s = "array_to_string(list_filter(string_split_regex(coalesce(subject_name, ''), '[\\s\\x{a0}]+'), lambda x: x <> ''), ' ')"
    for g in L.GENERA:
        s = f"regexp_replace({s}, '(?i){g.lower()}', '{g}', 'g')"
    first = "upper(substr(w[1], 1, 1)) || lower(substr(w[1], 2))"
    shaped = " or ".join(f"regexp_matches(n, {D.quoted(p)})" for p in L.STRAIN_PATTERNS)
    return (
        f"with s as (select claim_row_id, lower({D.strip(f'coalesce(subject_name, {D.quoted(str())})')}) as low, {s} as s from extracted_claims), w as (select *, string_split(s, ' ') as w from s), "
        f"n as (select *, case when s = '' then '' when len(w) < 2 then {first} else rtrim({first} || ' ' || lower(w[2]) || ' ' || array_to_string(w[3:], ' ')) end as n from w) "
        f"select claim_row_id, n as strain, (low <> '' and not {D.any_of('low', L.STRAIN_BLACKLIST)} and ({shaped}) and length(n) >= 5 and not regexp_matches(n, '[\\x{{4e00}}-\\x{{9fff}}]')) as is_valid from n"
    )


@query(_strain_sql())
def names_strain(spark, sf):
    c = F.col("subject_name")
    return _t(spark, sf, "extracted_claims").select("claim_row_id", text.strain_name(c).alias("strain"), text.strain_is_valid(c).alias("is_valid"))


@query(
    f"select entity_type, key, min(entity_id) as first_id, arg_min(name, entity_id) as canonical, count(*) as n from (select entity_id, {D.norm('entity_type')} as entity_type, {D.name('name')} as key, name from extracted_entities) where key <> '' group by 1, 2"
)
def entities_first_seen(spark, sf):
    return entities.first_seen(_t(spark, sf, "extracted_entities"))


@query(
    f"with x as (select entity_id, {D.norm('entity_type')} as entity_type, unnest(list_concat([name], coalesce(aliases, []))) as a from extracted_entities), y as (select entity_id, entity_type, {D.name('a')} as alias from x where a is not null) "
    "select entity_type, alias, min(entity_id) as entity_id, count(*) as n from y where alias <> '' group by 1, 2"
)
def entities_aliases(spark, sf):
    return entities.alias_lookup(_t(spark, sf, "extracted_entities"))


_SIMILAR = (
    f"with e as (select distinct {D.norm('entity_type')} as entity_type, {D.name('name')} as name from extracted_entities where {D.name('name')} <> ''), "
    "w as (select entity_type, name, list_distinct(list_filter(string_split(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_'), lambda x: x <> '')) as w from e), "
    "t as (select entity_type, name, len(w) as n, unnest(w) as word from w), c as (select a.entity_type, a.name as entity_a, b.name as entity_b, a.n as na, b.n as nb, count(*) as c from t a join t b on a.entity_type = b.entity_type and a.word = b.word and a.name < b.name group by all) "
    "select entity_type, entity_a, entity_b, round(c / (na + nb - c), 6) as similarity from c where round(c / (na + nb - c), 6) >= 0.6"
)


def _names(spark, sf) -> DataFrame:
    return entities.first_seen(_t(spark, sf, "extracted_entities")).select("entity_type", F.col("key").alias("name"))


@query(_SIMILAR)
def entities_similar(spark, sf):
    return graph.similar_names(_names(spark, sf))


@query(
    f"with e as (select distinct {D.norm('entity_type')} as entity_type, {D.name('name')} as name from extracted_entities where {D.name('name')} <> ''), w as (select *, list_distinct(string_split(lower(name), '_')) as w from e), "
    "p as (select a.entity_type, a.name as entity_a, b.name as entity_b, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) as j, contains(lower(a.name), lower(b.name)) or contains(lower(b.name), lower(a.name)) as c from w a join w b on a.entity_type = b.entity_type and a.name < b.name), "
    "s as (select entity_type, entity_a, entity_b, round(case when c then greatest(j, 0.75) else j end, 6) as similarity from p) select * from s where similarity >= 0.45"
)
def entities_candidates(spark, sf):
    return graph.candidate_names(_names(spark, sf))


@query()
def entities_merged(spark, sf):
    seen = entities.first_seen(_t(spark, sf, "extracted_entities"))
    return entities.merged_greedily(seen, graph.candidate_names(_names(spark, sf), least=0.92))


# graph -----------------------------------------------------------------------------------------------------------------------

_ENTITY = "e as (select subject_type as entity_type, subject as name, 1 as s from m union all select object_type, object, 0 from m), g as (select entity_type, name, sum(s)::bigint as as_subject, (count(*) - sum(s))::bigint as as_object from e group by 1, 2)"


@query(
    f"with {D.processed()}, {D.merged()}, {_ENTITY} select claim_id as node_id, 'claim' as node_type, null::varchar as entity_type, subject || ' has ' || direction || ' effect on ' || object as name from m "
    "union all select entity_type || '_' || name, 'entity', entity_type, name from g"
)
def graph_nodes(spark, sf):
    return graph.nodes(_merged(spark, sf))


@query(D.with_merged("select distinct subject_type || '_' || subject as src, claim_id as dst, 'subject_of' as relation from m union all select distinct claim_id, object_type || '_' || object, 'affects' from m"))
def graph_edges(spark, sf):
    return graph.edges(_merged(spark, sf))


@query(
    f"with {D.processed()}, {D.merged()}, {_ENTITY} select 'nodes:' || entity_type as measure, count(*) as n from g group by 1 union all select 'claims', count(*) from m union all select 'edges', 2 * count(*) from m "
    "union all select 'multi_evidence', count(*) from m where evidence_count > 1 union all select 'evidence', sum(evidence_count)::bigint from m"
)
def graph_statistics(spark, sf):
    return graph.statistics(_merged(spark, sf))


@query(D.with_merged("select subject as entity, subject_type as entity_type, 'as_subject' as role, claim_id, object as other, direction from m union all select object, object_type, 'as_object', claim_id, subject, direction from m"))
def graph_neighbours(spark, sf):
    return graph.neighbours(_merged(spark, sf))


@query(D.with_merged("select claim_id, subject, subject_type, object, object_type, direction, evidence_count, true as found from m union all select 'ffffffffffff', null, null, null, null, null, null, false"))
def graph_claim_details(spark, sf):
    m = _merged(spark, sf)
    asked = m.select("claim_id").unionByName(spark.createDataFrame([("ffffffffffff",)], "claim_id string"))
    return graph.details(m, asked)


@query(f"with {D.processed()} select pmid, count(distinct claim_id) as claim_count, string_agg(distinct claim_id, ';' order by claim_id) as claim_ids from a group by pmid")
def graph_by_article(spark, sf):
    return graph.by_article(claims.accepted(_rows(spark, sf)))


@query(
    D.with_merged(
        "select subject as set_id, count(distinct claim_id) as found_claims, count(distinct subject) = 1 as shared_subject, count(distinct object) = 1 as shared_object, bool_or(direction = 'positive') and bool_or(direction = 'negative') as conflict from m group by subject"
    )
)
def graph_compared(spark, sf):
    m = _merged(spark, sf)
    return graph.compared(m, m.select(F.col("subject").alias("set_id"), "claim_id"))


@query(
    D.with_merged(
        "select subject, object, count(*) filter (where direction = 'positive') as n_positive, count(*) filter (where direction = 'negative') as n_negative, sum(evidence_count)::bigint as evidence_count from m group by 1, 2 having n_positive > 0 and n_negative > 0"
    )
)
def graph_conflicts(spark, sf):
    return graph.conflicts(_merged(spark, sf))


_EDITS = (
    ("merge", "food", "yoghurt", "yogurt"), ("merge", "food", "no_such_food", "no_such_target"), ("rename", "food", "kephir", "kefir_grain_drink"), ("rename", "food", "kimchi", "yogurt"), ("retype", "food", "koumiss", "strain"), ("set_name", "outcome", "tc", "Total cholesterol"),
    ("set_name", "food", "kefir", "Kefir"), ("mark_out_of_scope", "food", "soy_sauce", "domain_drift"), ("delete_orphan", "food", "kefir", ""), ("delete_orphan", "food", "nothing_at_all", ""), ("paint", "food", "kefir", "blue"),
)
_NAMES_SQL = f"nm as (select distinct {D.norm('entity_type')} as t, {D.name('name')} as n from extracted_entities where {D.name('name')} <> '')"


def _edits_cte() -> str:
    """Entities ``k``, those without claims ``orp``, edits ``e0`` with their outcome ``er``, and what entities become ``e``."""
    values = ", ".join("(" + ", ".join(D.quoted(x) for x in e) + ")" for e in _EDITS)
    return f"""{D.processed()}, {D.merged()}, {_NAMES_SQL}, en as (select t, n, count(*) as c from (select subject_type as t, subject as n from m union all select object_type, object from m) group by 1, 2),
        orp as (select t, n from nm where not exists (select 1 from en where en.t = nm.t and lower(en.n) = lower(nm.n))), k as (select t, n, max(c) as c from (select * from en union all select t, n, 0 from orp) group by 1, 2),
        e0(action, t, n, target) as (select * from (values {values}) union all select 'delete_orphan', t, min(n), '' from orp group by t),
        er as (select e0.*, case when action = 'merge' then case when k.c is null and w.c is null then 'neither exists' end when action not in ('rename', 'retype', 'set_name', 'mark_out_of_scope', 'delete', 'delete_orphan') then 'unknown action' when k.c is null then 'no such entity'
          when action = 'rename' and w.c is not null and e0.n <> e0.target then 'new name exists' when starts_with(action, 'delete') and k.c > 0 then 'has claims' end as reason from e0 left join k on k.t = e0.t and k.n = e0.n left join k w on w.t = e0.t and w.n = e0.target),
        e as (select t, n, min(target) filter (where action in ('merge', 'rename')) as nn, min(target) filter (where action = 'retype') as nt, min(target) filter (where action = 'set_name') as dn, bool_or(action = 'mark_out_of_scope') as o, bool_or(starts_with(action, 'delete')) as gone from er where reason is null group by 1, 2)"""


def _edit_inputs(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = written(_merged(spark, sf), "merged-claims")
    alone = graph.orphans(m, _names(spark, sf))
    edits = spark.createDataFrame(list(_EDITS), "action string, entity_type string, name string, target string")
    return m, edits.unionByName(alone.groupBy("entity_type").agg(F.min("name").alias("name")).select(F.lit("delete_orphan").alias("action"), "entity_type", "name", F.lit("").alias("target"))), alone


@query(
    f"with {_edits_cte()} select claim_id, coalesce(s.nt, subject_type) || '_' || coalesce(s.nn, subject) as subject_id, coalesce(s.nt, subject_type) as subject_type, coalesce(s.dn, s.nn, subject) as subject, coalesce(b.nt, object_type) || '_' || coalesce(b.nn, object) as object_id, "
    "coalesce(b.nt, object_type) as object_type, coalesce(b.dn, b.nn, object) as object, concat_ws(';', case when s.o then 'entity_out_of_scope:' || subject_type || ':' || subject end, case when b.o then 'entity_out_of_scope:' || object_type || ':' || object end) as flags "
    "from m left join e s on s.t = subject_type and s.n = subject left join e b on b.t = object_type and b.n = object"
)
def graph_edited(spark, sf):
    return graph.edited(*_edit_inputs(spark, sf)).drop("direction", "evidence_count", "claim_text").withColumn("flags", F.array_join("quality_flags", ";")).drop("quality_flags")


@query(
    f"with {_edits_cte()} select coalesce(nt, k.t) || '_' || coalesce(nn, k.n) as node_id, coalesce(nt, k.t) as entity_type, coalesce(nn, k.n) as name, min(dn) as display_name, min(case when o then 'out_of_scope' end) as quality_status "
    "from k left join e on e.t = k.t and e.n = k.n where not coalesce(gone, false) group by 1, 2, 3"
)
def graph_edited_nodes(spark, sf):
    return graph.edited_nodes(*_edit_inputs(spark, sf))


@query(f"with {_edits_cte()} select distinct action, t as entity_type, n as name, target, reason is null as success, reason from er")
def graph_edit_results(spark, sf):
    return graph.edit_results(*_edit_inputs(spark, sf))


@query(D.with_merged(f", {_NAMES_SQL} select t as entity_type, n as name from nm where exists (select 1 from m where (subject_type = t and lower(subject) = lower(n)) or (object_type = t and lower(object) = lower(n)))"))
def graph_referenced(spark, sf):
    return graph.referenced(_merged(spark, sf), _names(spark, sf))


@query(D.with_merged(f", {_NAMES_SQL} select t as entity_type, n as name from nm where not exists (select 1 from m where subject_type = t and lower(subject) = lower(n)) and not exists (select 1 from m where object_type = t and lower(object) = lower(n))"))
def graph_orphans(spark, sf):
    return graph.orphans(_merged(spark, sf), _names(spark, sf))


_ASKED = ("yogurt", "goat milk", "Cholesterol", "kefir", "body weight", "zzzz")


@query(
    D.with_merged(
        ", q(query_id, query) as (values " + ", ".join(f"({i}, '{x.lower().replace(' ', '_')}')" for i, x in enumerate(_ASKED)) + "), n as (select distinct subject_type as t, subject as n from m union select distinct object_type, object from m), "
        "w as (select *, list_distinct(string_split(query, '_')) as a, list_distinct(string_split(lower(n), '_')) as b from q, n), x as (select query_id, t, n, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) as j, contains(query, lower(n)) or contains(lower(n), query) as c from w), "
        "s as (select query_id, t as entity_type, n as name, round(case when c then greatest(j, 0.75) else j end, 6) as score from x), r as (select *, row_number() over (partition by query_id order by score desc, name, entity_type) as rank from s where score > 0) select * from r where rank <= 8"
    )
)
def graph_search(spark, sf):
    q = spark.createDataFrame(list(enumerate(_ASKED)), "query_id int, query string")
    return graph.search_entities(q, graph.entities(_merged(spark, sf)), 8)


@query(
    D.with_merged(
        f", al as (select distinct {D.norm('entity_type')} as t, {D.name('name')} as n, {D.name('a')} as x from (select entity_type, name, unnest(aliases) as a from extracted_entities) where a is not null), al2 as (select t, n, string_agg(x, ';' order by x) as aliases from al where x <> '' and x <> n group by 1, 2), "
        "z as (select subject_type as t, subject as n, 1 as s, direction, evidence_count as v from m union all select object_type, object, 0, direction, evidence_count from m), "
        "g as (select t, n, count(*) filter (where s = 1) as as_subject, count(*) filter (where s = 0) as as_object, sum(v)::bigint as evidence, count(*) filter (where direction = 'positive') as n_positive, count(*) filter (where direction = 'negative') as n_negative, count(*) filter (where direction = 'neutral') as n_neutral from z group by 1, 2) "
        f"select e.t as entity_type, e.n as name, as_subject, as_object, evidence, n_positive, n_negative, n_neutral, aliases, evidence is not null as found from (select distinct {D.norm('entity_type')} as t, {D.name('name')} as n from extracted_entities where {D.name('name')} <> '') e left join g on g.t = e.t and g.n = e.n left join al2 on al2.t = e.t and al2.n = e.n"
    )
)
def graph_entity_info(spark, sf):
    e = _t(spark, sf, "extracted_entities")
    key = lambda c: text.clean_format(F.lower(text.strip(F.coalesce(c, F.lit("")))))
    alias = e.select(text.norm(F.col("entity_type")).alias("entity_type"), key(F.col("name")).alias("name"), F.explode("aliases").alias("a")).where("a is not null").select("entity_type", "name", key(F.col("a")).alias("alias")).where("alias <> ''")
    return graph.entity_info(_merged(spark, sf), alias, _names(spark, sf))


@query(D.with_merged("select distinct a.pmid, a.claim_id, m.subject || ' has ' || m.direction || ' effect on ' || m.object as claim_text from a join m using (claim_id) where a.pmid <> ''"))
def graph_article_claims(spark, sf):
    rows = claims.accepted(_rows(spark, sf))
    return graph.article_claims(rows, claims.merged(rows))


@query(D.with_merged("select subject_type, subject, count(*) as n_claims, sum(evidence_count)::bigint as evidence, row_number() over (partition by subject_type order by count(*) desc, subject) as rank from m group by 1, 2 qualify rank <= 10"))
def graph_top(spark, sf):
    return graph.top_entities(_merged(spark, sf))


# quality ---------------------------------------------------------------------------------------------------------------------


@query(
    f"with {D.processed()}, {D.merged()}, x as (select pmid, count(*) filter (where reason is null) as k, count(*) filter (where reason is not null) as l from p group by pmid), f as (select distinct subject from m where subject_type = 'food') "
    "select 'articles' as measure, count(*) as n from x union all select 'zero_claim_articles', count(*) from x where k = 0 union all select 'articles_with_warnings', count(*) from x where l > 0 union all select 'rejected', sum(l)::bigint from x "
    "union all select 'suspicious_foods', count(*) from f where " + " or ".join(f"regexp_matches(subject, {D.quoted(p)})" for p in L.SUSPICIOUS_FOOD_PATTERNS) + " union all select 'over_specific_foods', count(*) from f where length(subject) - length(replace(subject, '_', '')) >= 4 or regexp_matches(subject, '\\p{Nd}') "
    "union all select 'foods', count(*) from f union all select 'merged_claims', count(*) from m union all select 'multi_evidence_claims', count(*) from m where evidence_count > 1 union all select 'outcomes', count(distinct object) from m"
)
def quality_summary(spark, sf):
    rows = _rows(spark, sf)
    return quality.summary(rows, claims.merged(claims.accepted(rows)))


@query(
    f"with {D.processed()}, {D.merged()}, old as (select a.* from a join extracted_claims c on c.claim_row_id = a.ordinal where c.ingested_at < timestamptz '2024-09-01 00:00:00+00'), {D.merged('old', 'b')}, "
    "k as (select 'claim' as kind, claim_id as key from m union select 'food', subject from m where subject_type = 'food' union select 'outcome', object from m), "
    "l as (select 'claim' as kind, claim_id as key from b union select 'food', subject from b where subject_type = 'food' union select 'outcome', object from b) "
    "select kind, key, 'new' as change from (select * from k except select * from l) union all select kind, key, 'gone' from (select * from l except select * from k)"
)
def quality_difference(spark, sf):
    rows = _rows(spark, sf)
    old = _t(spark, sf, "extracted_claims").where("ingested_at < timestamp '2024-09-01 00:00:00'")
    return quality.difference(claims.merged(claims.accepted(rows)), claims.from_raw(old))


@query(
    f"with {D.processed()}, r as (select pmid, coalesce(bool_or(stype = 'strain' and regexp_matches(subject, '\\d')), false) as has_strain, coalesce(bool_or(length(coalesce(trim(dose_info.value), '')) > 0), false) as has_dose, "
    "coalesce(bool_or(length(coalesce(trim(dose_info.duration), '')) > 0), false) as has_duration, coalesce(bool_or(length(coalesce(effect_size, '')) > 0), false) as has_effect, coalesce(bool_or(length(coalesce(study_type, '')) > 0), false) as has_study_type from p group by pmid), "
    f"n as (select {D.strip('pmid')} as pmid, pmcid, coalesce(" + ", ".join(f"try_cast(nullif(regexp_extract(lower(coalesce(abstract, '')), {D.quoted(p)}, 1), '') as bigint)" for p in L.RULE_SAMPLE_PATTERNS) + ") as n from full_text), "
    "t as (select pmid, bool_or(length(coalesce(pmcid, '')) > 0) as f, bool_or(n is not null) as s from n group by pmid), "
    "j as (select r.*, coalesce(f, false) as has_full_text, coalesce(s, false) as has_sample_size from r left join t using (pmid)), "
    "x as (select *, has_sample_size::int + has_study_type::int + has_full_text::int + has_strain::int + has_dose::int + has_duration::int + has_effect::int as score from j) "
    "select pmid, has_strain, has_dose, has_duration, has_effect, has_study_type, has_full_text, has_sample_size, score, case when score >= 6 then 'complete' when score >= 4 then 'partial' when score >= 2 then 'minimal' else 'insufficient' end as level, "
    "concat_ws(',', case when not has_sample_size then 'sample_size' end, case when not has_study_type then 'study_type' end, case when not has_full_text then 'full_text' end, case when not has_strain then 'strain' end, case when not has_dose then 'dose' end, case when not has_duration then 'duration' end) as missing from x"
)
def quality_completeness(spark, sf):
    doses = _t(spark, sf, "extracted_claims").select(F.col("claim_row_id").alias("ordinal"), F.trim("dose_info.value").alias("dose"), F.trim("dose_info.duration").alias("duration"))
    rows = _rows(spark, sf).join(doses, "ordinal")
    return quality.completeness(rows, _t(spark, sf, "full_text"))


_REVIEW = "'# Report' || chr(10) || string_agg('### ISSUE-' || o || ': [' || kind || '] - ' || e || chr(10) || '- **Severity**: ' || sev || chr(10) || '- **Action**: ' || act || chr(10) || '- **PMIDs**: ' || pmid || chr(10), '' order by o)"


def _review_parts(spark, sf) -> DataFrame:
    c = _t(spark, sf, "extracted_entities").where("name is not null")
    pick = lambda names, by: F.element_at(F.array(*[F.lit(x) for x in names]), (F.pmod(F.col("entity_id") + by, F.lit(len(names))) + 1).cast("int"))
    return c.select(
        F.floor(F.col("entity_id") / 10).alias("review_id"), F.col("entity_id").alias("o"), F.coalesce("entity_type", F.lit("none")).alias("kind"), text.strip(F.regexp_replace("name", r"[\n\r]", " ")).alias("e"),
        pick(("Critical", "major", "minor", "strange"), 0).alias("sev"), pick(("merge into", "Rename", "retype", "update_type food", "title case", "manual review", "delete orphan", "mark out of scope", "no-op", "whatever"), 3).alias("act"), F.coalesce("pmid", F.lit("")).alias("pmid"),
    )


_REVIEW_CTE = (
    "r as (select entity_id // 10 as review_id, entity_id as o, coalesce(entity_type, 'none') as kind, " + D.strip("regexp_replace(name, '[\\n\\r]', ' ', 'g')") + " as e, "
    "(['critical', 'major', 'minor', 'unknown'])[entity_id % 4 + 1] as severity, (['merge', 'rename', 'retype', 'retype', 'set_name', 'preserve', 'delete_orphan', 'mark_out_of_scope', 'no_change', 'skip'])[(entity_id + 3) % 10 + 1] as action from extracted_entities where name is not null)"
)


def _issues(spark, sf) -> DataFrame:
    p = _review_parts(spark, sf)
    section = F.concat(F.lit("### ISSUE-"), F.col("o"), F.lit(": ["), F.col("kind"), F.lit("] - "), F.col("e"), F.lit("\n- **Severity**: "), F.col("sev"), F.lit("\n- **Action**: "), F.col("act"), F.lit("\n- **PMIDs**: "), F.col("pmid"), F.lit("\n"))
    reviews = p.groupBy("review_id").agg(F.concat(F.lit("# Report\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", section.alias("s")))), lambda x: x["s"]), "")).alias("review"))
    return quality.issues(reviews)


@query(f"with {_REVIEW_CTE} select review_id, 'ISSUE-' || o as issue_id, kind as issue_type, e as entity, severity, action from r")
def review_issues(spark, sf):
    return _issues(spark, sf).select("review_id", "issue_id", "issue_type", "entity", "severity", "action")


@query(
    f"with {_REVIEW_CTE}, l as (select *, case severity when 'critical' then 0 when 'major' then 1 when 'minor' then 2 else 3 end as s, case action when 'merge' then 0 when 'rename' then 1 when 'retype' then 3 when 'delete_orphan' then 4 when 'set_name' then 5 else 6 end as ap from r where action not in ('preserve', 'no_change', 'skip')), "
    "k as (select *, row_number() over (partition by review_id order by s, ap, o, e) as rank from l) select review_id, rank, 'ISSUE-' || o as issue_id, e as entity, action, severity from k where rank <= 3"
)
def review_selected(spark, sf):
    return quality.selected(_issues(spark, sf), 3)


# corpus ----------------------------------------------------------------------------------------------------------------------

_LATEST = f"l as (select * exclude (pmid, k) from (select *, {D.strip('pmid')} as pm, row_number() over (partition by {D.strip('pmid')} order by fetched_at desc) as k from articles where {D.strip('pmid')} <> '') where k = 1)"


def _latest(spark, sf) -> DataFrame:
    return corpus.latest_articles(_t(spark, sf, "articles"))


@query(f"with {_LATEST} select pm as pmid, title, journal, year, length(abstract) as n_chars, len(publication_types) as n_types from l")
def corpus_latest(spark, sf):
    return _latest(spark, sf).select("pmid", "title", "journal", "year", F.length("abstract").alias("n_chars"), F.when(F.col("publication_types").isNotNull(), F.size("publication_types")).alias("n_types"))


@query(
    f"with {_LATEST}, s as (select fulltext_id, {D.strip('pmid')} as pmid, {D.strip('coalesce(title, {0})'.format(D.quoted('')))} as st, {D.strip('coalesce(abstract, {0})'.format(D.quoted('')))} as sa from full_text), "
    f"m as (select pm as pmid, {D.strip('coalesce(title, {0})'.format(D.quoted('')))} as mt, {D.strip('coalesce(abstract, {0})'.format(D.quoted('')))} as ma from l), j as (select s.*, mt, ma, m.pmid is not null as known from s left join m using (pmid)), "
    "o as (select *, length(sa) > 0 and (length(coalesce(ma, '')) = 0 or length(sa) > length(ma) * 1.25) as own from j where known or length(sa) > 0) "
    "select pmid, case when coalesce(mt, '') <> '' then mt else st end as title, case when own then sa else coalesce(ma, '') end as abstract, case when own then 'selected' else 'metadata' end as text_source from o"
)
def corpus_resolved(spark, sf):
    return corpus.resolved(_t(spark, sf, "full_text"), _latest(spark, sf))


#: A list of journals with a rank indicator. Invented values.
JOURNALS = (("Annals of Fermented Nutrition", 12.5), ("Gut Ecology", 4.2), ("Journal of Dietary Trials", 2.1), ("Dairy", 0.7), ("Nutritional Claims", 0.2), ("Microbial Cuisine Letters and Reviews", 0.0))
_WORDS = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(journal, 'journal', '', 'g'), 'of', '', 'g'), 'and', '', 'g'), 'the', '', 'g')"
_JOURNAL_CTE = (
    "jl(ordinal, title, sjr) as (values " + ", ".join(f"({i}, '{t.lower()}', {v}::double)" for i, (t, v) in enumerate(JOURNALS)) + f"), jn as (select distinct lower({D.strip('journal')}) as journal from articles where {D.strip('journal')} <> ''), "
    "jx as (select journal, arg_min(title, ordinal) as title from jn join jl on journal = title group by 1), jy as (select journal, arg_min(title, ordinal) as title from jn join jl on contains(journal, title) or contains(title, journal) where journal not in (select journal from jx) group by 1), "
    f"jz as (select journal, arg_min(title, ordinal) as title from (select journal, {D.strip(_WORDS)} as w from jn where journal not in (select journal from jx) and journal not in (select journal from jy)) q join jl on w <> '' and contains(title, w) group by 1), "
    "jm as (select jn.journal, coalesce(jx.title, jy.title, jz.title) as title, case when jx.title is not null then 'exact' when jy.title is not null then 'contained' when jz.title is not null then 'words' else 'none' end as how from jn left join jx using (journal) left join jy using (journal) left join jz using (journal))"
)


def _journals(spark) -> DataFrame:
    return spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(JOURNALS)], "ordinal int, title string, sjr double")


INSTITUTIONS = ("Northmere", "Institute of Food Science", "Nordhaven", "University", "MIT")
FUNDERS = {"government": ("NIH", "Ministry of Science", "Research Council", "National"), "non_profit": ("Foundation", "Society", "Trust"), "industry": ("Inc.", "Ltd.", "Dairy", "Company"), "academic": ("University", "Institute", "College")}


def _ladder_sql(x: str, steps, other: str) -> str:
    return "case " + " ".join(f"when {x} >= {a} then {b}" for a, b in steps) + f" else {other} end"


def _paper_sql() -> str:
    types = "lower(coalesce(array_to_string(list_transform(publication_types, lambda t: coalesce(t.name, '')), chr(10)), ''))"
    study = "case " + " ".join(f"when contains(ty, '{m}') then {s}" for m, s, _ in L.STUDY_LADDER) + " else 0.0 end"
    label = "case " + " ".join(f"when contains(ty, '{m}') then '{n}'" for m, _, n in L.STUDY_LADDER) + " else 'Unknown' end"
    body = "coalesce(title, '') || ' ' || coalesce(abstract, '')"
    sizes = ", ".join(f"list_max(list_filter(list_transform(regexp_extract_all({body}, {D.quoted('(?i)' + p)}, 1), lambda x: try_cast(x as bigint)), lambda x: x < 100000))" for p in L.SAMPLE_SIZE_PATTERNS)
    affil = "flatten(list_transform(coalesce(authors_full, []), lambda a: coalesce(a.affiliations, [])))"
    hits = f"len(list_filter(af, lambda x: {D.any_of('lower(coalesce(x, {0}))'.format(D.quoted('')), [i.lower() for i in INSTITUTIONS])}))"
    fund = {k: f"len(list_filter(ag, lambda x: {D.any_of('x', [i.lower() for i in v])}))" for k, v in FUNDERS.items()}
    kind = (
        f"case when len(ag) = 0 then 'none' when {fund['industry']} > 0 and ({fund['government']} > 0 or {fund['non_profit']} > 0) then 'mixed' when {fund['industry']} > 0 then 'industry' when {fund['government']} > 0 then 'government' "
        f"when {fund['non_profit']} > 0 then 'non_profit' when {fund['academic']} > 0 then 'academic' else 'unknown' end"
    )
    trial = _ladder_sql("sample_size", [(1000, 10.0), (500, 9.0), (200, 8.0), (100, 7.0), (50, 5.0), (1, 3.0)], "0.0")
    other = _ladder_sql("sample_size", [(500, 10.0), (200, 8.0), (100, 7.0), (50, 5.0), (1, 3.0)], "0.0")
    grade = "case " + " ".join(f"when total >= {a} then '{b}'" for a, b in [(9.0, "A+"), (8.5, "A"), (8.0, "A-"), (7.5, "B+"), (7.0, "B"), (6.5, "B-"), (6.0, "C+"), (5.5, "C"), (5.0, "C-"), (3.0, "D")]) + " else 'F' end"
    tier = "case when journal_key = '' then 'unknown' when sjr is null then 'unranked' " + " ".join(f"when sjr >= {a} then '{n}'" for a, _, n in ((10, 10, "top"), (5, 9, "excellent"), (3, 8, "high"), (2, 7, "good"), (1, 6, "medium"), (0.5, 5, "fair"))) + " when sjr > 0 then 'low' else 'unranked' end"
    points = "case journal_tier when 'unknown' then 0 when 'top' then 10 when 'excellent' then 9 when 'high' then 8 when 'good' then 7 when 'medium' then 6 when 'fair' then 5 when 'low' then 4 else 3 end"
    return f"""with {_LATEST}, {_JOURNAL_CTE}, b as (select pm as pmid, lower({D.strip("coalesce(journal, '')")}) as journal_key, {types} as ty, coalesce({sizes}, 0) as sample_size, case when len({affil}) > 0 then {affil} else coalesce(author_affiliations, []) end as af,
        list_transform(coalesce(grants, []), lambda g: lower(coalesce(g.agency, ''))) as ag from l),
        c as (select pmid, journal_key, ({study})::double as study_score, {label} as study_label, sample_size, (case when regexp_matches(ty, 'randomized|meta-analysis|systematic review') then {trial} else {other} end)::double as sample_score,
        (case when len(af) = 0 then 0.0 else {_ladder_sql(hits, [(5, 10.0), (3, 9.0), (2, 8.0), (1, 6.0)], '3.0')} end)::double as institution_score, {kind} as funding from b),
        c2 as (select c.* exclude (journal_key), {tier} as journal_tier from c left join jm on jm.journal = c.journal_key left join jl on jl.title = jm.title),
        d as (select *, ({points})::double as journal_score, (case funding when 'mixed' then 6 when 'industry' then 3 when 'government' then 10 when 'non_profit' then 8 when 'academic' then 7 else 5 end)::double as funding_score from c2),
        e as (select *, round(study_score * 0.25::double + sample_score * 0.2::double + journal_score * 0.2::double + institution_score * 0.15::double + funding_score * 0.2::double, 6) as total from d)
        select *, {grade} as grade from e"""


@query(_paper_sql())
def corpus_paper_scores(spark, sf):
    return _papers(spark, sf)


def _papers(spark, sf) -> DataFrame:
    return corpus.paper_scores(_latest(spark, sf), INSTITUTIONS, FUNDERS, _journals(spark))


def _rule_cte() -> str:
    has = lambda *x: f"len(list_intersect(tn, [{', '.join(D.quoted(y) for y in x)}])) > 0"
    both = "lower(concat_ws(chr(10), coalesce(abstract, ''), coalesce(title, '')))"
    sample = "coalesce(" + ", ".join(f"try_cast(nullif(regexp_extract(lower(coalesce(abstract, '')), {D.quoted(p)}, 1), '') as bigint)" for p in L.RULE_SAMPLE_PATTERNS) + ")"
    rel = "lower(coalesce(title, '') || ' ' || coalesce(abstract, '') || ' ' || array_to_string(list_concat(coalesce(mesh_terms, []), coalesce(keywords, [])), ' '))"
    count = " + ".join(f"contains(rt, '{t}')::int" for t in L.FERMENTED_TERMS)
    return f"""{_LATEST}, r0 as (select *, list_transform(coalesce(publication_types, []), lambda t: coalesce(t.name, '')) as tn, lower(coalesce(title, '')) as lt, lower(coalesce(abstract, '')) as la, {both} as bt, {sample} as sn, {rel} as rt from l),
        r1 as (select *, ({count}) as nf, regexp_matches(rt, 'randomized|clinical trial') as rct from r0), h as (select distinct {D.strip('pmid')} as pm, true as ft from full_text),
        r2 as (select r1.*, coalesce(ft, false) as has_full_text, (case when {has('Randomized Controlled Trial', 'Clinical Trial')} or regexp_matches(lt, 'randomized|randomised') or regexp_matches(la, 'double-blind|placebo-controlled') then 100
          when regexp_matches(lt, 'crossover|cross-over') then 90 when {has('Cohort')} then 70 when {has('Case-Control')} then 50 when {has('Meta-Analysis', 'Review', 'Systematic Review')} or regexp_matches(lt, 'meta-analysis|systematic review') then 30 else 40 end)::double as study_design,
          (case when {D.any_of('bt', L.METABOLIC_TERMS)} and regexp_matches(coalesce(abstract, ''), '\\d') then 100 when {D.any_of('bt', L.METABOLIC_TERMS)} then 80 when {D.any_of('bt', L.GUT_TERMS)} and regexp_matches(coalesce(abstract, ''), '\\d') then 75
          when {D.any_of('bt', L.GUT_TERMS)} then 60 else 40 end)::double as outcome_clarity, (case when sn is null then 50 when sn >= 100 then 100 when sn >= 50 then 80 when sn >= 20 then 60 else 40 end)::double as sample,
          (case when nf >= 2 and rct then 5 when nf >= 1 and rct then 4 when nf >= 2 then 3 when nf >= 1 then 2 else 1 end)::double as relevance from r1 left join h using (pm)),
        r as (select *, round(study_design * 0.4::double + outcome_clarity * 0.3::double + sample * 0.2::double + (case when has_full_text then 100.0::double else 0.0::double end) * 0.1::double, 2) as overall from r2)"""


@query(f"with {_rule_cte()} select pm as pmid, study_design, outcome_clarity, sample, relevance, has_full_text, overall from r")
def corpus_rule_scores(spark, sf):
    return corpus.rule_scores(_latest(spark, sf), _t(spark, sf, "full_text"))


def _expansion_sql() -> str:
    hit = lambda col, terms: " + ".join(f"contains({col}, '{t}')::int" for t in terms)
    x = "list_filter([" + ", ".join(f"case when contains(body, '{t}') then '{t}' end" for t in sorted(L.EXCLUDED_TERMS)) + "], lambda t: t is not null)"
    return f"""with {_rule_cte()}, x0 as (select *, lower(coalesce(title, '') || ' ' || coalesce(abstract, '') || ' ' || array_to_string(coalesce(mesh_terms, []), ' ')) as body, lower(array_to_string(tn, ' ')) as ty from r),
        x1 as (select *, {hit('body', L.DOMAIN_TERMS)} as d, {hit('lt', L.DOMAIN_TERMS)} as t, {hit('body', L.OUTCOME_TERMS)} as o, {x} as ex, regexp_matches(ty || ' ' || lt, 'review|meta-analysis') as rv,
          regexp_matches(ty || ' ' || lt || ' ' || la, 'clinical trial|randomized|randomised|crossover') as tr, length(coalesce(pmcid, '')) > 0 as pc from x0)
        select pm as pmid, round(overall + least(d, 5) * 3 + least(t, 3) * 5 + least(o, 5) * 2 + tr::int * 18 + rv::int * 6 + (rv and pc)::int * 8 + (pc and not rv)::int * 3 + (length(coalesce(abstract, '')) > 0)::int * 2
          - (len(ex) > 0)::int * 25 - (d = 0)::int * 50 - (rv and not pc)::int * 8, 2) as score,
          concat_ws(';', case when tr then 'clinical_trial_or_rct' end, case when rv then 'review' end, case when rv and pc then 'review_with_pmc_fulltext' end, case when pc and not rv then 'has_pmcid' end, case when t > 0 then 'domain_term_in_title' end,
          case when o > 0 then 'health_outcome_terms' end, case when len(ex) > 0 then 'excluded_context:' || array_to_string(ex[1:3], ',') end, case when d = 0 then 'no_domain_term' end, case when rv and not pc then 'review_abstract_only' end) as reasons from x1"""


@query(_expansion_sql())
def corpus_expansion(spark, sf):
    a = _latest(spark, sf)
    return corpus.expansion(a, corpus.rule_scores(a, _t(spark, sf, "full_text")))


@query(f"with {_JOURNAL_CTE} select journal, title, how from jm")
def corpus_journals(spark, sf):
    return corpus.journal_match(_t(spark, sf, "articles"), _journals(spark))


@query(
    f"with {_LATEST}, x as (select pm, lower(coalesce(title, '')) as t, lower(coalesce(title, '')) || chr(10) || lower(coalesce(abstract, '')) as b from l) select pm as pmid, case when {D.any_of('b', L.REVIEW_MARKERS)} or contains(b, ' review') or ends_with(t, 'review') then 'review' "
    f"when {D.any_of('b', L.PRIMARY_MARKERS)} then case when contains(b, 'crossover') then 'Crossover trial' else 'RCT' end else 'cohort' end as study_type from x"
)
def corpus_study_types(spark, sf):
    return _latest(spark, sf).select("pmid", text.study_type(F.col("title"), F.col("abstract"), F.lit("cohort")).alias("study_type"))


# sentences and patterns --------------------------------------------------------------------------------------------------------

_SPLIT = "string_split(regexp_replace({0}, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"


@query(f"select fulltext_id, len({_SPLIT.format(D.strip('abstract'))}) as n_sentences, list_max(list_transform({_SPLIT.format(D.strip('abstract'))}, lambda x: length(x))) as longest from full_text where abstract is not null")
def text_sentences(spark, sf):
    s = text.sentences(F.col("abstract"))
    return _t(spark, sf, "full_text").where("abstract is not null").select("fulltext_id", F.size(s).alias("n_sentences"), F.array_max(F.transform(s, lambda x: F.length(x))).alias("longest"))


@query(f"with {_LATEST}, s as (select pm as pmid, unnest({_SPLIT.format(D.strip('abstract'))}) as sentence, generate_subscripts({_SPLIT.format(D.strip('abstract'))}, 1) - 1 as pos from l where abstract is not null) select pmid, pos, sentence from s where {D.any_of('lower(sentence)', L.RESULT_MARKERS)}")
def text_result_sentences(spark, sf):
    return evidence.result_sentences(_latest(spark, sf)).select("pmid", "pos", "sentence")


#: Subjects and outcomes of these texts for the extraction by rules. Fixed values.
SUBJECTS = (("kefir", "kefir"), ("yogurt", "yogurt"), ("kimchi", "kimchi"), ("kombucha", "kombucha"), ("placebo", "placebo"))
OUTCOMES = {"total_cholesterol": ("total cholesterol",), "fat_mass": ("fat mass",), "body_weight": ("body weight",), "sleep_quality": ("sleep quality",), "hs_crp": ("c-reactive protein", "hscrp"), "insulin_resistance": ("insulin resistance",), "uric_acid": ("uric acid",), "constipation": ("stool consistency", "stool frequency")}


_EVERY_OUTCOME = {k: tuple(dict.fromkeys((*L.OUTCOME_ALIASES.get(k, ()), *OUTCOMES.get(k, ())))) for k in L.OUTCOME_ALIASES | OUTCOMES}
_EVERY_SUBJECT = tuple(dict.fromkeys((*L.RETRY_SUBJECTS, *SUBJECTS)))


def _rule_claims_sql() -> str:
    low = "lower(sentence)"
    subject = "coalesce(" + ", ".join(f"case when contains({low}, '{p}') then '{s}' end" for p, s in _EVERY_SUBJECT) + ")"
    met = "list_filter([" + ", ".join(f"case when {D.any_of(low, v)} then {{'k': {i}, 'outcome': '{k}'}} end" for i, (k, v) in enumerate(_EVERY_OUTCOME.items())) + "], lambda x: x is not null)"
    eff = f"case when {D.any_of(low, L.NO_EFFECT_MARKERS)} then 'no_significant_effect' when {D.any_of(low, L.DECREASE_MARKERS)} then 'decreased' when {D.any_of(low, L.INCREASE_MARKERS)} then 'increased' else 'changed' end"
    return f"""with {_LATEST}, s as (select pm as pmid, unnest({_SPLIT.format(D.strip('abstract'))}) as sentence, generate_subscripts({_SPLIT.format(D.strip('abstract'))}, 1) - 1 as pos from l where abstract is not null),
        c as (select *, {subject} as subject, {met} as met from s where {D.any_of(low, L.RESULT_MARKERS)} and not {D.any_of(low, L.NON_RESULT_PHRASES)}), u as (select pmid, pos, sentence, subject, unnest(met) as x from c where subject is not null),
        v as (select pmid, pos, sentence, subject, x.k as k, x.outcome as outcome, {eff} as eff from u), w as (select *, {D.inferred('eff', 'outcome')} as meant, row_number() over (partition by pmid, subject, x_outcome order by pos, k) as first from (select *, outcome as x_outcome from v)),
        y as (select *, case when eff = 'no_significant_effect' then 'neutral' when meant = 'unclear' then 'beneficial' else meant end as health_interpretation, row_number() over (partition by pmid order by pos, k) as claim_ordinal from w where first = 1)
        select pmid, subject, outcome, pos, eff as effect_direction, health_interpretation, case when eff = 'no_significant_effect' then 'neutral' when health_interpretation = 'harmful' then 'negative' else 'positive' end as direction,
        nullif(regexp_extract(sentence, '(?i)P\\s*[=<>]\\s*0?\\.\\d+', 0), '') as p_value, claim_ordinal from y where claim_ordinal <= 12"""


@query(_rule_claims_sql())
def text_rule_claims(spark, sf):
    s = evidence.result_sentences(_latest(spark, sf))
    return evidence.rule_claims(s, _EVERY_OUTCOME, _EVERY_SUBJECT).select("pmid", "subject", "outcome", "pos", "effect_direction", "health_interpretation", "direction", "p_value", "claim_ordinal")


def _backfilled_sql() -> str:
    from claimloom.operators.evidence import BROAD_SUBJECTS, DIRECTION_WORDS, METHOD_PHRASE

    flat = D.strip("regexp_replace(coalesce(abstract, ''), '[\\s\\x{a0}]+', ' ', 'g')")
    listed = lambda x: "[" + ", ".join(D.quoted(y) for y in x) + "]"
    words = lambda c: f"list_distinct(list_filter(regexp_extract_all(translate(lower(coalesce({c}, '')), '_-/', '   '), '[a-z][a-z0-9]+'), lambda t: length(t) >= 3 and t not in ({', '.join(D.quoted(y) for y in L.STOPWORDS)})))"
    both = lambda x, y: f"len(list_intersect({x}, {y}))"
    toward = "case direction " + " ".join(f"when '{k}' then {both('w', listed(v))}" for k, v in DIRECTION_WORDS.items()) + " else 0 end"
    literal = " + ".join(f"case when length(coalesce({c}, '')) > 0 and contains(lower(sentence), lower({c})) then 4.0 else 0.0 end" for c in ("p_value", "effect_size"))
    return f"""{D.processed()}, {_LATEST}, sn as (select pm, list_filter(string_split(regexp_replace({flat}, '([.!?])\\s+([A-Z0-9(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: length(trim(x)) >= 25) as ss from l),
        cu as (select pm, unnest(ss) as sentence, generate_subscripts(ss, 1) - 1 as pos from sn), w1 as (select pm, pos, sentence, {words('sentence')} as w from cu),
        pa as (select ordinal, pos, sentence, w, direction, p_value, effect_size, {words('subject')} as sw, {words('object')} as ow, {words("subject || ' has ' || direction || ' effect on ' || object")} as cw from a join w1 on w1.pm = a.pmid),
        q as (select *, {both('w', listed(L.METHOD_CUES))} as method, {both('w', listed(L.RESULT_CUES))} as result from pa),
        sc as (select ordinal, pos, sentence, ({both('w', 'sw')} * 4.0 + {both('w', 'ow')} * 5.0 + {both('w', 'cw')} + least({toward}, 2) * 0.5 + case when regexp_matches(lower(sentence), {D.quoted(METHOD_PHRASE)}) then -25.0 when method > 0 and result = 0 then -12.0 when method > 0 then -4.0 else 0.0 end
          + least(result, 3) + {literal} + case when len(sw) > 0 and {both('w', 'sw')} = 0 and {both('w', listed(BROAD_SUBJECTS))} > 0 then 1.0 else 0.0 end)::double as score from q),
        bf as (select ordinal, case when score >= 8 then sentence else '' end as snippet, score from (select *, row_number() over (partition by ordinal order by score desc, pos) as k from sc) where k = 1)"""


@query(f"with {_backfilled_sql()} select ordinal, snippet, score from bf")
def text_backfilled(spark, sf):
    return evidence.backfilled(claims.accepted(_rows(spark, sf)), _latest(spark, sf))


def _dose_sql(c: str) -> str:
    power = r"(?i)(\d+(?:\.\d+)?)\s*(?:\x{d7}|x|\*)?\s*10\^?(\d+)\s*(?:CFU|cfu)(?:/day)?"
    rest = [(r"(?i)(\d{1,3}(?:,\d{3})+)\s*(?:CFU|cfu)", "'CFU'"), (r"(?i)(\d{10,})\s*(?:CFU|cfu)", "'CFU'"), (r"(?i)(\d+(?:\.\d+)?)\s*(g|mg|mcg)\s*(?:per|/)\s*(day|d)", None), (r"(?i)(\d+(?:\.\d+)?)\s*(g|mg|ml|capsules?|tablets?)\s*(?:daily|per day|/day)?", None)]
    q = D.quoted
    value = f"case when regexp_matches({c}, {q(power)}) then try_cast(regexp_extract({c}, {q(power)}, 1) as double) * pow(10.0, try_cast(regexp_extract({c}, {q(power)}, 2) as double)) "
    unit = f"case when regexp_matches({c}, {q(power)}) then 'CFU/day' "
    for p, u in rest:
        value += f"when regexp_matches({c}, {q(p)}) then try_cast(replace(regexp_extract({c}, {q(p)}, 1), ',', '') as double) "
        unit += f"when regexp_matches({c}, {q(p)}) then {u or f'regexp_extract({c}, {q(p)}, 2)'} "
    return f"{value} end as dose_value, {unit} end as dose_unit"


def _days_sql(c: str) -> str:
    patterns = [rf"(?i)(?:for|over|during)\s+(\d+)\s*(?:{u})" for u in ("weeks?|wk", "months?|mo", "days?|d")]
    patterns += [rf"(?i){w}\s+(?:period|duration)\s*:?\s*(\d+)\s*(?:week|month|day)" for w in ("intervention", "treatment", "study")]
    patterns += [rf"(?i)(\d+)\s*(?:{u})" for u in ("weeks?|wk", "months?|mo", "days?|d")]
    out = []
    for p in patterns:
        w, n = f"lower(regexp_extract({c}, {D.quoted(p)}, 0))", f"try_cast(nullif(regexp_extract({c}, {D.quoted(p)}, 1), '') as bigint)"
        out.append(f"case when contains({w}, 'week') then {n} * 7 when contains({w}, 'month') then {n} * 30 when contains({w}, 'day') then {n} end")
    return f"coalesce({', '.join(out)})"


def _sizes_sql(c: str) -> str:
    return ", ".join(f"list_max(list_filter(list_transform(regexp_extract_all({c}, {D.quoted('(?i)' + p)}, 1), lambda x: try_cast(x as bigint)), lambda x: x < 100000))" for p in L.SAMPLE_SIZE_PATTERNS)


@query(
    f"select doc_id, nullif(regexp_extract(text, '(?i)P\\s*[=<>]\\s*0?\\.\\d+', 0), '') as p_value, coalesce({_sizes_sql('text')}, 0) as largest_sample, {_days_sql('text')} as duration_days, {_dose_sql('text')}, "
    f"{D.any_of('lower(text)', L.ABSTENTION_MARKERS)} as abstains from documents where text is not null"
)
def text_patterns(spark, sf):
    t = F.col("text")
    d = text.dose(t)
    return spread(_t(spark, sf, "documents").select("doc_id", "text")).where("text is not null").select("doc_id", text.p_value(t).alias("p_value"), text.largest_sample(t).alias("largest_sample"), text.duration_days(t).alias("duration_days"), d["value"].alias("dose_value"), d["unit"].alias("dose_unit"), text.abstains(t).alias("abstains"))


@query(
    "select fulltext_id, len(map_keys(sections)) as n_sections, list_filter(map_entries(sections), lambda e: contains(lower(e.key), 'method'))[1].value is not null as has_methods, list_sort(map_keys(sections))[1] as first_title from full_text where sections is not null"
)
def text_sections(spark, sf):
    e = F.filter(F.map_entries("sections"), lambda x: F.lower(x["key"]).contains("method"))
    return _t(spark, sf, "full_text").where("sections is not null").select("fulltext_id", F.size(F.map_keys("sections")).alias("n_sections"), F.get(e, F.lit(0))["value"].isNotNull().alias("has_methods"), F.get(F.array_sort(F.map_keys("sections")), F.lit(0)).alias("first_title"))


# retrieval -------------------------------------------------------------------------------------------------------------------


def _hits(spark, sf, k: int = 20) -> DataFrame:
    e = _t(spark, sf, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = retrieval.vector_search(q, e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), k + 1, dim=64)
    rest = found.where("query_id <> item_id").drop("rank")
    return retrieval.ranked(rest, k)


_COSINE = "q as (select vec_id as query_id, embedding::double[] as v, label as ql from embeddings where vec_id % 50 = 0), s as (select query_id, ql, vec_id as item_id, label, round(list_cosine_similarity(v, embedding::double[]), 9) as score from q, embeddings where vec_id <> query_id), h as (select *, row_number() over (partition by query_id order by score desc, item_id) as rank from s)"


@query(f"with {_COSINE} select query_id, item_id, round(score, 6) as score, rank from h where rank <= 10")
def retrieval_vectors(spark, sf):
    return _hits(spark, sf, 10).select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


def _metrics_sql() -> str:
    cuts = ", ".join(f"(count(*) filter (where rank <= {c} and label = ql) > 0)::int as hit_{c}, round(count(*) filter (where rank <= {c} and label = ql) / max(n), 6) as recall_{c}" for c in retrieval.CUTS)
    return f"{_COSINE}, n as (select query_id, count(*) as n from s where label = ql group by 1), f as (select h.*, n.n from h join n using (query_id) where rank <= 20), per as (select query_id, ql, max(n) as n_gold, round(coalesce(1 / min(rank) filter (where label = ql), 0), 6) as reciprocal_rank, {cuts} from f group by query_id, ql)"


def _per_query(spark, sf) -> DataFrame:
    e = _t(spark, sf, "embeddings")
    a = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    gold = a.join(e.select(F.col("vec_id").alias("item_id"), "label"), "label").where("query_id <> item_id")
    return retrieval.metrics(_hits(spark, sf), gold)


@query(f"with {_metrics_sql()} select * exclude (ql) from per")
def retrieval_metrics(spark, sf):
    return _per_query(spark, sf)


@query(
    f"with {_metrics_sql()} select coalesce(ql::varchar, 'all') as label, count(*) as n, round(avg(reciprocal_rank), 6) as reciprocal_rank, " + ", ".join(f"round(avg({m}_{c}), 6) as {m}_{c}" for c in retrieval.CUTS for m in ("hit", "recall")) + " from per group by grouping sets ((), (ql))"
)
def retrieval_summary(spark, sf):
    labels = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "label")
    return retrieval.metric_summary(_per_query(spark, sf).join(labels, "query_id"), "label")


_LEXICAL = f"""qs as (select claim_row_id as query_id, evidence_snippet as query from extracted_claims where claim_row_id % 50 = 0 and length(coalesce(evidence_snippet, '')) > 0),
    it as (select claim_id as item_id, subject || ' has ' || direction || ' effect on ' || object as text, [replace(subject, '_', ' '), replace(object, '_', ' ')] as phrases from m),
    qw as (select query_id, w, count(*) as n from (select query_id, unnest({D.bag('query')}) as w from qs) group by 1, 2), iw as (select item_id, w, count(*) as n from (select item_id, unnest({D.bag("replace(text, '_', ' ')")}) as w from it) group by 1, 2),
    qn as (select query_id, sqrt(sum(n * n)) as v from qw group by 1), inn as (select item_id, sqrt(sum(n * n)) as v from iw group by 1), o as (select query_id, item_id, sum(least(qw.n, iw.n)) as c from qw join iw using (w) group by 1, 2),
    sc as (select query_id, item_id, round(c / (qn.v * inn.v) + 0.25::double * len(list_filter(phrases, lambda p: p <> '' and contains(lower(query), p))), 6) as score from o join qn using (query_id) join inn using (item_id) join qs using (query_id) join it using (item_id)),
    rk as (select *, row_number() over (partition by query_id order by score desc, item_id) as rank from sc)"""


def _lexical(spark, sf) -> DataFrame:
    q = _t(spark, sf, "extracted_claims").where("claim_row_id % 50 = 0 and length(coalesce(evidence_snippet, '')) > 0").select(F.col("claim_row_id").alias("query_id"), F.col("evidence_snippet").alias("query"))
    spaced = lambda c: F.replace(F.col(c), F.lit("_"), F.lit(" "))
    items = claims.heads(claims.accepted(_rows(spark, sf))).select(F.col("claim_id").alias("item_id"), spaced("claim_text").alias("text"), F.array(spaced("subject"), spaced("object")).alias("phrases"))
    return retrieval.lexical_top(q, items, 10)


@query(D.with_merged(f", {_LEXICAL} select query_id, item_id, score, rank from rk where rank <= 10"))
def retrieval_lexical(spark, sf):
    return _lexical(spark, sf)


@query(
    "with d as (select vec_id as a, embedding::double[] as v, label from embeddings where vec_id % 50 = 0), s as (select label as query_id, vec_id as item_id, round(list_cosine_similarity(v, embedding::double[]), 9) as score from d, embeddings), "
    "t as (select query_id, item_id, max(score) as score from (select *, row_number() over (partition by a order by score desc, item_id) as r from (select d.a, d.label as query_id, vec_id as item_id, round(list_cosine_similarity(v, embedding::double[]), 9) as score from d, embeddings)) where r <= 20 group by 1, 2), "
    "k as (select *, row_number() over (partition by query_id order by score desc, item_id) as rank from t) select query_id, item_id, round(score, 6) as score, rank from k where rank <= 10"
)
def retrieval_fused(spark, sf):
    e = _t(spark, sf, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = retrieval.vector_search(q, e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), 20, dim=64)
    by_label = found.join(e.select(F.col("vec_id").alias("query_id"), "label"), "query_id").select(F.col("label").alias("query_id"), "item_id", "score")
    return retrieval.fused(by_label, 10).select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


@query(
    "with p as (select a.vec_id as a, b.vec_id as b, a.embedding::double[] as x, b.embedding::double[] as y from embeddings a join embeddings b on b.vec_id = a.vec_id + 1) select a, b, round(list_cosine_similarity(x, y), 6) as cosine from p"
)
def vectors_cosine(spark, sf):
    e = _t(spark, sf, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, "a").select("a", "b", F.round(vectors.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


# audits ----------------------------------------------------------------------------------------------------------------------

FIELDS = ("subject_correct", "outcome_correct", "direction_correct", "snippet_supports_claim", "pmid_traceable")


def _labels_cte() -> str:
    def c(f: str) -> str:
        s = rf"lower(regexp_replace({f}, '^[\s\x{{a0}}]+|[\s\x{{a0}}.]+$', '', 'g'))"
        return f"case when {s} in ('yes', 'y') then 'yes' when {s} in ('no', 'n') then 'no' when {s} in ('unclear', '?') then 'unclear' end"

    each = " union all ".join(f"select audit_id, reviewer_id, decision_id, decided_at, '{f}' as field, {c(f)} as label from audit_decisions" for f in FIELDS)
    return f"l as (select * from ({each}) where label is not null)"


_PAIRS = f"""{_labels_cte()}, z as (select audit_id, field, reviewer_id, label from (select *, row_number() over (partition by audit_id, field, reviewer_id order by decided_at desc, decision_id desc) as k from l) where k = 1),
    y as (select *, row_number() over (partition by audit_id, field order by reviewer_id) as k from z), d as (select audit_id, field, max(label) filter (where k = 1) as a, max(label) filter (where k = 2) as b from y where k <= 2 group by 1, 2 having a is not null and b is not null)"""


def _labels(spark, sf) -> DataFrame:
    return audit.long_labels(_t(spark, sf, "audit_decisions"), FIELDS)


@query(
    f"with {_PAIRS}, s as (select field, count(*) as n, avg((a = b)::int::double) as o, " + " + ".join(f"avg((a = '{x}')::int::double) * avg((b = '{x}')::int::double)" for x in audit.LABELS) + " as e from d group by field) "
    "select field, n, round(o, 4) as observed, round(case when e > 1 - 1e-12 then 1 else (o - e) / (1 - e) end, 4) as kappa from s"
)
def audit_kappa(spark, sf):
    return audit.kappa(audit.double_reviews(_labels(spark, sf)))


@query(
    f"with {_labels_cte()} select field, count(*) filter (where label = 'yes') as n_yes, count(*) filter (where label = 'no') as n_no, count(*) filter (where label = 'unclear') as n_unclear, round(n_yes / nullif(n_yes + n_no, 0), 4) as precision, "
    "round(n_yes / count(*), 4) as yes_rate, round(n_unclear / count(*), 4) as unclear_rate from l group by field"
)
def audit_rates(spark, sf):
    return audit.rates(_labels(spark, sf))


@query(f"with {_PAIRS} select audit_id, field, a, b, case when a = b then a when a = 'no' or b = 'no' then 'no' else 'unclear' end as label from d")
def audit_resolved(spark, sf):
    return audit.resolved(audit.double_reviews(_labels(spark, sf)))


@query(
    f"with {_PAIRS}, g as (select distinct field, x as a from d, (values ('yes'), ('no'), ('unclear')) v(x)) select g.field, g.a, count(*) filter (where d.b = 'yes') as yes, count(*) filter (where d.b = 'no') as no, count(*) filter (where d.b = 'unclear') as unclear from g left join d on d.field = g.field and d.a = g.a group by 1, 2"
)
def audit_crosstab(spark, sf):
    return audit.crosstab(audit.double_reviews(_labels(spark, sf)))


@query(D.with_merged("select claim_id, direction, draw from (select claim_id, direction, row_number() over (partition by direction order by md5('20|' || claim_id), claim_id) as draw from m) where draw <= case direction when 'positive' then 45 when 'negative' then 25 when 'neutral' then 25 else 0 end"))
def audit_sample(spark, sf):
    return audit.stratified(_merged(spark, sf), "direction", "claim_id", {"positive": 45, "negative": 25, "neutral": 25}, "20").select("claim_id", "direction", "draw")


# benchmarks ------------------------------------------------------------------------------------------------------------------


@query(
    D.with_merged(
        ", f as (select *, row_number() over (partition by object, subject order by evidence_count desc, confidence desc, subject, claim_id) as k from m), n as (select object, count(distinct subject) as n_subjects from m group by 1 having n_subjects >= 2), "
        "t as (select *, row_number() over (partition by object order by evidence_count desc, confidence desc, subject, claim_id) as place from f where k = 1) select object, n_subjects, place, subject, claim_id from t join n using (object) where place <= 3"
    )
)
def benchmark_comparisons(spark, sf):
    return benchmarks.comparisons(_merged(spark, sf))


def _gold(spark, sf) -> DataFrame:
    r = claims.accepted(_rows(spark, sf)).where("ordinal % 50 = 0")
    return r.select(F.col("ordinal").alias("item_id"), "pmid", "subject", "object", F.when(F.col("ordinal") % 100 == 0, "negative").otherwise(F.col("direction")).alias("direction"))


_GOLD = "g as (select ordinal as item_id, pmid, subject as gs, object as go, case when ordinal % 100 = 0 then 'negative' else direction end as gd from a where ordinal % 50 = 0), r as (select distinct pmid, claim_id, subject as s, object as o, direction as d from a)"


def _tidy(x: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({x}), '[-\s]+', '_', 'g'), '_+', '_', 'g')"


@query(
    f"with {D.processed()}, {_GOLD}, j as (select item_id, pmid, claim_id, ({_tidy('gs')} = {_tidy('s')})::int as sm, ({_tidy('go')} = {_tidy('o')})::int as om, (gd = d)::int as dm from g join r using (pmid)), "
    "c as (select item_id, claim_id, count(distinct pmid) as overlap, max(sm) as sm, max(om) as om, max(dm) as dm from j where sm + om > 0 group by 1, 2), k as (select *, rank() over (partition by item_id order by overlap desc, sm desc, om desc, dm desc) as k from c) select * exclude (k) from k where k = 1"
)
def benchmark_repaired(spark, sf):
    return benchmarks.repaired_gold(_gold(spark, sf), claims.accepted(_rows(spark, sf)))


def _set(x: str) -> str:
    return f"list_distinct(list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '_'), lambda t: t <> ''))"


def _jaccard(a: str, b: str) -> str:
    return f"case when len({a}) = 0 or len({b}) = 0 then 0 else len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) end"


_COMPATIBLE = (
    f"{D.processed()}, {_GOLD}, gp as (select distinct item_id, pmid from g), rt as (select item_id, a.pmid, row_number() over (partition by item_id order by min(ordinal), a.pmid) as rank from g join a on a.object = g.go group by item_id, a.pmid), "
    f"j as (select item_id, claim_id, {_jaccard(_set('gs'), _set('s'))} as ss, {_jaccard(_set('go'), _set('o'))} as os from g join r using (pmid)), b as (select * from (select *, round((ss + os) / 2, 6) as score from j) qualify row_number() over (partition by item_id order by score desc, claim_id) = 1), "
    "hp as (select distinct pmid from a), nn as (select gp.item_id, count(*) as n, count(hp.pmid) as held, count(*) filter (where rank <= 10) as n10, count(*) filter (where rank <= 20) as n20 from gp left join hp using (pmid) left join rt on rt.item_id = gp.item_id and rt.pmid = gp.pmid group by 1), "
    "co as (select nn.item_id, round(held / n, 4) as coverage, round(n10 / n, 4) as recall_10, round(n20 / n, 4) as recall_20, coalesce(score, 0) as anchor_score, case when held = 0 then 'gold_pmids_absent_from_new_graph' when n10 = n then 'all_gold_pmids_retrieved_top10' when n10 > 0 then 'partial_gold_pmids_retrieved_top10' when n20 > 0 then 'gold_pmids_rank_11_20' "
    "when round(coalesce(ss, 0), 9) >= 0.8 and round(coalesce(os, 0), 9) >= 0.8 then 'anchor_claim_present_but_not_retrieved_top20' when round(coalesce(ss, 0), 9) >= 0.8 or round(coalesce(os, 0), 9) >= 0.8 then 'gold_pmids_present_but_anchor_changed' else 'gold_pmids_present_but_no_close_anchor' end as category from nn left join b using (item_id))"
)


def _compatible(spark, sf) -> DataFrame:
    rows, gold = claims.accepted(_rows(spark, sf)), _gold(spark, sf)
    hits = gold.select("item_id", "object").distinct().join(rows.select("object", "pmid", "ordinal"), "object").groupBy("item_id", "pmid").agg(F.min("ordinal").alias("o"))
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("o", "pmid"))).where("rank <= 20")
    return benchmarks.compatibility(gold, rows, ranked)


@query(f"with {_COMPATIBLE} select * from co")
def benchmark_compatibility(spark, sf):
    return _compatible(spark, sf)


@query(f"with {_COMPATIBLE}, t as (select *, case item_id // 50 % 3 when 0 then 'description' when 1 then 'reason' else 'comparison' end as question_type from co) select coalesce(question_type, 'all') as question_type, category, count(*) as n, round(avg(coverage), 4) as avg_coverage, round(avg(recall_10), 4) as avg_recall_10, round(avg(recall_20), 4) as avg_recall_20 from t group by cube (question_type, category)")
def benchmark_compatibility_summary(spark, sf):
    kind = F.element_at(F.array(F.lit("description"), F.lit("reason"), F.lit("comparison")), (F.floor(F.col("item_id") / 50) % 3 + 1).cast("int"))
    return summaries.compatibility(_compatible(spark, sf).withColumn("question_type", kind))


# transcripts -----------------------------------------------------------------------------------------------------------------

_CALLS = "c as (select user_id as item_id, event_id as ordinal, event_type || ' ' || json_extract_string(props, '$.k') as command from events where user_id is not null), e as (select item_id, command, count(*) as n, min(ordinal) as f from c group by 1, 2), i as (select item_id, sum(n)::bigint as n_calls, count(*) as n_commands, sum(n - 1)::bigint as repeats, arg_min(command, {'a': -n, 'b': f}) as most_called from e group by 1)"


def _calls(spark, sf) -> DataFrame:
    e = _t(spark, sf, "events").where("user_id is not null")
    return transcripts.call_statistics(e.select(F.col("user_id").alias("item_id"), F.col("event_id").alias("ordinal"), F.concat("event_type", F.lit(" "), F.get_json_object("props", "$.k")).alias("command")))


@query(f"with {_CALLS} select * from i")
def transcripts_calls(spark, sf):
    return _calls(spark, sf)


@query(
    f"with {_CALLS}, g as (select 'all' as g, n_calls from i union all select (item_id % 5)::varchar, n_calls from i), s as (select g, list_sort(list(n_calls)) as v from g group by 1) "
    'select g as "group", len(v) as n, round(list_avg(v), 4) as mean, list_median(v) as median, case when len(v) = 1 then v[1] else v[(len(v) * 9) // 10] end as p90, v[len(v)] as most from s'
)
def transcripts_summary(spark, sf):
    return transcripts.call_summary(_calls(spark, sf).withColumn("kind", F.col("item_id") % 5), "kind")


@query(
    f"with {D.processed()}, r as (select pmid as item_id, 'See ' || string_agg(distinct 'PMID: ' || pmid || ' for claim ' || claim_id, '; ' order by 'PMID: ' || pmid || ' for claim ' || claim_id) || case when max(ordinal) % 3 = 0 then '. There is no direct evidence.' else '.' end as t, count(distinct claim_id) as n, max(ordinal) as o from a where regexp_matches(pmid, '^\\d{{6,9}}$') group by pmid) "
    "select item_id, 1 as n_pmids, n as n_claims, o % 3 = 0 as abstains, case when o % 2 = 0 then true end as pmid_hit, case when o % 2 = 0 then 1.0::double end as pmid_recall from r"
)
def transcripts_scored(spark, sf):
    rows = claims.accepted(_rows(spark, sf)).where(F.col("pmid").rlike(r"^\d{6,9}$"))
    part = F.concat(F.lit("PMID: "), "pmid", F.lit(" for claim "), "claim_id")
    a = rows.groupBy(F.col("pmid").alias("item_id")).agg(F.concat(F.lit("See "), F.array_join(F.array_sort(F.collect_set(part)), "; "), F.when(F.max("ordinal") % 3 == 0, ". There is no direct evidence.").otherwise(".")).alias("response"), F.max("ordinal").alias("o"))
    gold = a.where("o % 2 = 0").select("item_id", F.col("item_id").alias("pmid"))
    return transcripts.scored_answers(a, gold)


# streams and runs ------------------------------------------------------------------------------------------------------------


@query(D.with_merged("select claim_id, subject, object, direction, evidence_count, confidence, first_seen, last_updated from m"))
def stream_merged(spark, sf):
    out = incremental.merge_directory(spark, f"{sf}/extracted_claims.parquet", "claim-stream")
    return out.select("claim_id", "subject", "object", "direction", "evidence_count", "confidence", "first_seen", "last_updated")


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events where ts is not null group by 1, 2")
def stream_windows(spark, sf):
    return incremental.windowed_events(_t(spark, sf, "events").where("ts is not null")).withColumn("total", F.round("total", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    f"with recursive {D.processed()}, st as (select pmid, min(ordinal) as ordinal, count(distinct subject) as e, count(*) filter (where reason is not null) as w from p group by pmid), sq as materialized (select *, row_number() over (order by ordinal) as i, count(*) over () as n from st), "
    "go(i, ordinal, a, e, w, stop) as (select i, ordinal, 1, e, w, 1 >= 25 or e >= 80 or w >= 3 or i = n from sq where i = 1 union all select s.i, s.ordinal, case when g.stop then 1 else g.a + 1 end, case when g.stop then s.e else g.e + s.e end, case when g.stop then s.w else g.w + s.w end, "
    "s.i = s.n or case when g.stop then 1 else g.a + 1 end >= 25 or case when g.stop then s.e else g.e + s.e end >= 80 or case when g.stop then s.w else g.w + s.w end >= 3 from go g join sq s on s.i = g.i + 1) select 'run' as run_id, ordinal, stop from go"
)
def run_check_points(spark, sf):
    rows = _rows(spark, sf)
    step = rows.groupBy("pmid").agg(F.min("ordinal").alias("ordinal"), F.countDistinct("subject").alias("new_entities"), F.count_if(F.col("reject_reason").isNotNull()).alias("warnings"))
    return incremental.check_points(step.withColumn("run_id", F.lit("run")))
