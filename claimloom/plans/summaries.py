"""Queries of summaries, selections, grounding and benchmark items, each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom import lexicons as L
from claimloom.functions import text
from claimloom.operators import benchmarks, claims, corpus, entities, evidence, graph, quality, summaries, transcripts
from claimloom.plans import dialect as D
from claimloom.plans import evidence as E
from claimloom.plans.evidence import _t, query

# papers ----------------------------------------------------------------------------------------------------------------------


def _rules(spark, sf) -> DataFrame:
    return corpus.rule_scores(E._latest(spark, sf), _t(spark, sf, "full_text"))


@query(f"with {E._rule_cte()} select count(*) as n, round(avg(relevance), 2) as avg_relevance, round(avg(overall), 2) as avg_quality, count(*) filter (where overall >= 70) as high_quality_count, count(*) filter (where has_full_text) as with_xml_count from r")
def corpus_score_summary(spark, sf):
    return summaries.scores(_rules(spark, sf))


@query(f"with {E._rule_cte()} select pm as pmid, overall, relevance, has_full_text from r where overall >= 60 and relevance >= 1 and has_full_text order by overall desc, pmid limit 50")
def corpus_filtered(spark, sf):
    return summaries.filtered(_rules(spark, sf), min_quality=60, min_relevance=1, require_text=True, top=50).select("pmid", "overall", "relevance", "has_full_text")


@query(f"with {E._rule_cte()} select pm as pmid, overall from r order by pm limit 40 offset 20")
def corpus_page(spark, sf):
    return summaries.page(_rules(spark, sf).select("pmid", "overall"), "pmid", offset=20, limit=40)


@query(E._paper_sql().rsplit("select *,", 1)[0] + "select pmid, total, total >= 5.0 as include from e")
def corpus_included(spark, sf):
    """Grade C- or better, which is a total of 5."""
    return summaries.included(E._papers(spark, sf), min_grade="C-").select("pmid", "total", "include")


@query(f"with {E._rule_cte()} select case when regexp_matches(ty0, 'randomized') then 'RCT' when regexp_matches(ty0, 'meta-analysis') then 'Meta-analysis' when regexp_matches(ty0, 'systematic review') then 'Systematic review' else 'Other' end as study_type, count(*) as n from (select *, lower(array_to_string(tn, chr(10))) as ty0 from r) group by 1")
def corpus_detected_types(spark, sf):
    return corpus.detected_types(E._latest(spark, sf)).groupBy("study_type").agg(F.count("*").alias("n"))


_JUDGED = f"{E._rule_cte()}, jd as (select pm as pmid, case when relevance >= 3 then 'RELEVANT' when relevance = 2 then 'PARTIALLY' when sample < 60 then null else 'NOT_RELEVANT' end as label, overall / 100 as confidence from r), ju as (select pmid, confidence, case when label is null then 'failed' when coalesce(confidence, 0) < 0.45 then 'UNCERTAIN' else label end as relevance from jd)"


def _judgments(spark, sf) -> DataFrame:
    rel = F.when(F.col("relevance") >= 3, "RELEVANT").when(F.col("relevance") == 2, "PARTIALLY").when(F.col("sample") < 60, None).otherwise("NOT_RELEVANT")
    return _rules(spark, sf).select("pmid", rel.alias("relevance"), (F.col("overall") / 100).alias("confidence"))


@query(f"with {_JUDGED} select count(*) as total, count(*) filter (where relevance <> 'failed') as processed, " + ", ".join(f"count(*) filter (where relevance = '{a}') as {b}" for a, b in (("RELEVANT", "relevant"), ("PARTIALLY", "partially"), ("NOT_RELEVANT", "not_relevant"), ("UNCERTAIN", "uncertain"), ("failed", "failed"))) + " from ju")
def corpus_relevance_summary(spark, sf):
    return summaries.relevance(_judgments(spark, sf), least=0.45)


@query(f"with {_JUDGED} select l.pm as pmid, l.title, ju.relevance, ju.confidence as relevance_confidence from l join ju on ju.pmid = l.pm where ju.relevance in ('RELEVANT', 'PARTIALLY')")
def corpus_selected(spark, sf):
    return summaries.selected(E._latest(spark, sf).select("pmid", "title"), _judgments(spark, sf), least=0.45)


@query(
    f"with {E._rule_cte()}, c as (select pm as pmid, row_number() over (order by overall desc, pm) as rank, relevance >= 1 as include, overall / 100 as confidence, length(coalesce(abstract, '')) > 0 as usable, nf > 0 as in_scope from r) select pmid, row_number() over (order by rank) as place from c where include and confidence >= 0.5 and usable and in_scope qualify place <= 30"
)
def corpus_accepted(spark, sf):
    """Candidates in the order of their scores, which stands for a rank given by a model."""
    scored = _rules(spark, sf)
    a = E._latest(spark, sf).select("pmid", "abstract", text.contains_any(F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")), F.array_join(F.concat(F.coalesce("mesh_terms", F.array().cast("array<string>")), F.coalesce("keywords", F.array().cast("array<string>"))), " "))), L.FERMENTED_TERMS).alias("in_scope"))
    c = scored.join(a, "pmid").select("pmid", F.struct((-F.col("overall")).alias("o"), "pmid").alias("rank"), (F.col("relevance") >= 1).alias("include"), (F.col("overall") / 100).alias("confidence"), (F.length(F.coalesce("abstract", F.lit(""))) > 0).alias("usable"), "in_scope")
    return summaries.accepted(c, 30, least=0.5).select("pmid", F.row_number().over(Window.orderBy("rank")).alias("place"))  # of 30 rows


# extraction ------------------------------------------------------------------------------------------------------------------


@query(f"with {D.processed()} select count(*) as total, count(*) filter (where length(trim(evidence_snippet)) = 0) as empty, count(*) filter (where length(trim(evidence_snippet)) > 0) as nonempty, 0::bigint as backfilled from a")
def quality_evidence(spark, sf):
    return summaries.evidence(claims.accepted(E._rows(spark, sf)))


@query(f"with lv as ({E.SQL['quality_completeness']}) select level, count(*) as n, round(count(*) * 100 / (select count(*) from lv), 1) as percent, count(*) filter (where not has_full_text and missing <> '') as need_full_text from lv group by level")
def quality_levels(spark, sf):
    return summaries.levels(E.quality_completeness(spark, sf))


@query(
    f"with {D.processed()}, x as (select pmid, count(*) as original, count(*) filter (where reason is null) as kept, list_sort(list(distinct coalesce(reason, '') || ':' || subject) filter (where reason is not null))[1:5] as invalid from p group by pmid) "
    "select pmid, original, kept, coalesce(array_to_string(invalid, ';'), '') as invalid from x"
)
def quality_validation(spark, sf):
    return quality.validation(E._rows(spark, sf)).withColumn("invalid", F.array_join("invalid", ";"))


_BOTH = D.norm("coalesce(title, '') || ' ' || coalesce(abstract, '')")


@query(f"with {E._LATEST} select pm as pmid from l where not {D.any_of(_BOTH, L.OUT_OF_SCOPE_SUBJECTS)} and {D.any_of(_BOTH, L.IN_SCOPE_SUBJECTS)}")
def extraction_retries(spark, sf):
    """Articles whose text calls for another pass if the first gave no claim."""
    return corpus.worth_retrying(E._latest(spark, sf)).select("pmid")


@query(f"with {D.processed()}, w as (select *, (ordinal % 3)::int as pass from p), f as (select pmid, min(pass) as pass from w where reason is null group by pmid) select w.pmid, w.ordinal, w.pass, w.claim_id from w join f on f.pmid = w.pmid and f.pass = w.pass where w.reason is null")
def extraction_cascade(spark, sf):
    """Passes told apart by the row: of each article the first pass that leaves a claim counts."""
    return claims.first_pass(E._rows(spark, sf).withColumn("pass", (F.col("ordinal") % 3).cast("int"))).select("pmid", "ordinal", "pass", "claim_id")


@query(
    f"with {D.processed()}, al as (select {D.strip('pmid')} as pm, entity_id, {D.name('name')} as canonical, unnest(list_concat([name], coalesce(aliases, []))) as a from extracted_entities), k as (select pm, {D.name('a')} as alias, arg_min(canonical, entity_id) as canonical from al where a is not null and {D.name('a')} <> '' and canonical <> '' group by 1, 2) "
    "select p.ordinal, coalesce(s.canonical, p.subject) as subject, coalesce(o.canonical, p.object) as object from p left join k s on s.pm = p.pmid and s.alias = p.subject left join k o on o.pm = p.pmid and o.alias = p.object"
)
def claims_canonical(spark, sf):
    return claims.canonical_names(E._rows(spark, sf), _t(spark, sf, "extracted_entities")).select("ordinal", "subject", "object")


# grounding -------------------------------------------------------------------------------------------------------------------

_LABEL = lambda f: rf"lower(regexp_replace({f}, '^[\s\x{{a0}}]+|[\s\x{{a0}}.]+$', '', 'g'))"
_VERDICTS = f"""{D.processed()}, {D.merged()}, v as (select decision_id as ordinal, a.claim_id, case when {_LABEL('snippet_supports_claim')} in ('yes', 'y') then 'supports' when {_LABEL('snippet_supports_claim')} in ('no', 'n') then 'contradicts' when {_LABEL('snippet_supports_claim')} in ('unclear', '?') then 'insufficient' end as support_label,
    case when {_LABEL('direction_correct')} in ('yes', 'y') then 'yes' when {_LABEL('direction_correct')} in ('no', 'n') then 'no' when {_LABEL('direction_correct')} in ('unclear', '?') then 'unclear' end as direction_supported, decision_id % 10 / 10 as confidence, a.evidence_snippet as best_sentence, a.eff as effect_direction, a.hi as health_interpretation
    from audit_decisions d join a on a.ordinal = d.claim_row_id),
    vg as (select * exclude (support_label, confidence), case when support_label = 'supports' and coalesce(direction_supported, '') <> 'yes' then 'insufficient' else coalesce(support_label, 'insufficient') end as support_label,
      case when length(best_sentence) = 0 then least(c1, 0.3::double) else c1 end as confidence from (select *, case when support_label = 'supports' and coalesce(direction_supported, '') <> 'yes' then least(confidence, 0.5::double) else confidence end as c1 from v))"""


def _verdicts(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = claims.accepted(E._rows(spark, sf))
    word = lambda c: F.lower(F.regexp_replace(F.col(c), r"^[\s\x{a0}]+|[\s\x{a0}.]+$", ""))
    pick = lambda c, table: F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)])[word(c)]
    yes = {"yes": "yes", "y": "yes", "no": "no", "n": "no", "unclear": "unclear", "?": "unclear"}
    support = {"yes": "supports", "y": "supports", "no": "contradicts", "n": "contradicts", "unclear": "insufficient", "?": "insufficient"}
    d = _t(spark, sf, "audit_decisions").select(F.col("decision_id").alias("d"), F.col("claim_row_id").alias("ordinal"), pick("snippet_supports_claim", support).alias("support_label"), pick("direction_correct", yes).alias("direction_supported"))
    j = d.join(rows.select("ordinal", "claim_id", "evidence_snippet", "effect_direction", "health_interpretation"), "ordinal")
    v = j.select(F.col("d").alias("ordinal"), "claim_id", "support_label", "direction_supported", (F.col("d") % 10 / 10).alias("confidence"), F.col("evidence_snippet").alias("best_sentence"), "effect_direction", "health_interpretation")
    return summaries.grounded(v), claims.merged(rows)


@query(f"with {_VERDICTS} select ordinal, claim_id, support_label, direction_supported, round(confidence, 6) as confidence from vg")
def grounding_verdicts(spark, sf):
    v, _ = _verdicts(spark, sf)
    return v.select("ordinal", "claim_id", "support_label", "direction_supported", F.round("confidence", 6).alias("confidence"))


@query(
    f"with {_VERDICTS}, z as (select * from vg qualify row_number() over (partition by claim_id order by ordinal desc) = 1) select m.claim_id, case when z.claim_id is not null then coalesce(z.effect_direction, 'unclear') end as effect_direction_verified, case when z.claim_id is not null then coalesce(z.health_interpretation, 'unclear') end as health_interpretation_verified, "
    "case when z.claim_id is not null then coalesce(support_label, 'unverified') end as grounding_status, case when z.claim_id is not null then coalesce(direction_supported, 'unclear') end as direction_supported, case when z.claim_id is not null then coalesce(support_label = 'supports' and direction_supported = 'yes' and coalesce(z.confidence, 0) >= 0.7 and length(best_sentence) > 0, false) end as high_confidence_grounded "
    "from m left join z using (claim_id)"
)
def grounding_annotated(spark, sf):
    v, m = _verdicts(spark, sf)
    return summaries.annotated(m, v)


@query(f"with {_VERDICTS} " + " union all ".join(f"select '{f}' as field, '{x}' as label, count(*) filter (where {f} = '{x}') as n from vg" for f, labels in summaries.VERDICTS.items() for x in labels))
def grounding_summary(spark, sf):
    return summaries.verdicts(_verdicts(spark, sf)[0])


@query(f"with {_VERDICTS} select support_label, count(*) filter (where direction_supported = 'yes') as yes, count(*) filter (where direction_supported = 'no') as no, count(*) filter (where direction_supported = 'unclear') as unclear from vg group by 1")
def grounding_crosstab(spark, sf):
    return summaries.crossed(_verdicts(spark, sf)[0], "support_label", "direction_supported", ("yes", "no", "unclear"))


@query(
    f"with {_VERDICTS}, t as (select count(*) as n from (select claim_id from vg group by 1 having count(*) > 1)), w as (select count(*) as n from (select distinct claim_id from m) q where not exists (select 1 from vg where vg.claim_id = q.claim_id)), b as (select count(*) as n from vg where not coalesce(direction_supported in ('yes', 'no', 'unclear'), false)) "
    "select * from (select 'duplicate' as problem, n from t union all select 'missing', n from w union all select 'bad label', n from b) where n > 0"
)
def grounding_checked(spark, sf):
    v, m = _verdicts(spark, sf)
    return summaries.checked(m, v, key="claim_id", labels=("yes", "no", "unclear"), column="direction_supported")


# evaluations -----------------------------------------------------------------------------------------------------------------

_TYPES = ("description", "evidence_lookup", "reason", "comparison")
_ITEMS = f"{E._COSINE}, it as (select vec_id as item_id, (['{_TYPES[0]}', '{_TYPES[1]}', '{_TYPES[2]}', '{_TYPES[3]}'])[vec_id // 50 % 4 + 1] as question_type, case when vec_id // 50 % 5 = 0 then 'no_answer' else 'graph_positive' end as expected_answer_type from embeddings where vec_id % 50 = 0), gd as (select query_id as item_id, item_id as claim_id from s where label = ql), ht as (select query_id as item_id, item_id as claim_id, score, rank from h where rank <= 20)"
_EVALUATED = f"""{_ITEMS}, tp as (select item_id, max(score) as ms, least(count(*), 5) as c from ht group by 1), ng as (select item_id, count(*) as n from gd group by 1), mt as (select ht.item_id, min(rank) as f, count(*) filter (where rank <= 5) as k from ht join gd using (item_id, claim_id) group by 1),
    ev as (select it.*, coalesce(ms, 0) as max_similarity, coalesce(ms, 0) < 0.35 as abstained, case when coalesce(ms, 0) < 0.35 then 0 else coalesce(c, 0) end::int as n_cited, case when coalesce(ms, 0) < 0.35 then 0 else coalesce(k, 0) end as hit, n, f from it left join tp using (item_id) left join ng using (item_id) left join mt using (item_id)),
    ei as (select item_id, question_type, expected_answer_type, max_similarity, abstained, n_cited, case when expected_answer_type <> 'no_answer' then (hit > 0)::int end as claim_hit, case when expected_answer_type <> 'no_answer' then round(coalesce(hit / n, 0), 6) end as claim_recall, case when expected_answer_type <> 'no_answer' then round(coalesce(1 / f, 0), 6) end as mrr, case when expected_answer_type = 'no_answer' then abstained end as no_answer_correct from ev)"""


def _evaluated(spark, sf) -> DataFrame:
    e = _t(spark, sf, "embeddings")
    q = e.where("vec_id % 50 = 0")
    at = F.floor(F.col("vec_id") / 50)
    items = q.select(F.col("vec_id").alias("item_id"), F.element_at(F.array(*map(F.lit, _TYPES)), (at % 4 + 1).cast("int")).alias("question_type"), F.when(at % 5 == 0, "no_answer").otherwise("graph_positive").alias("expected_answer_type"))
    gold = q.select(F.col("vec_id").alias("item_id"), "label").join(e.select(F.col("vec_id").alias("claim_id"), "label"), "label").where("item_id <> claim_id").select("item_id", "claim_id")
    hits = E._hits(spark, sf).select(F.col("query_id").alias("item_id"), F.col("item_id").alias("claim_id"), "score", "rank")
    return summaries.retrieval_items(hits, gold, items, threshold=0.35)


@query(f"with {_EVALUATED} select item_id, question_type, expected_answer_type, round(max_similarity, 6) as max_similarity, abstained, n_cited, claim_hit, claim_recall, mrr, no_answer_correct from ei")
def evaluation_items(spark, sf):
    return _evaluated(spark, sf).withColumn("max_similarity", F.round("max_similarity", 6))


def _mean_sql(c: str, where: str, name: str | None = None) -> str:
    return f"round(avg({c}) filter (where {where}), 4) as {name or c}"


_NONE, _SOME = "expected_answer_type = 'no_answer'", "expected_answer_type <> 'no_answer'"


@query(
    f"with {_EVALUATED} select coalesce(question_type, 'all') as question_type, count(*) as count, round(avg(n_cited), 2) as avg_cited_claims, round(avg(max_similarity), 4) as avg_max_similarity, count(*) filter (where {_SOME}) as graph_positive_count, {_mean_sql('claim_hit', _SOME)}, {_mean_sql('claim_recall', _SOME)}, {_mean_sql('mrr', _SOME)}, "
    f"{_mean_sql('abstained::int', _SOME, 'false_abstention_rate')}, count(*) filter (where {_NONE}) as no_answer_count, {_mean_sql('no_answer_correct::int', _NONE, 'no_answer_correct')}, {_mean_sql('abstained::int', _NONE, 'abstention_rate')} from ei group by grouping sets ((), (question_type))"
)
def evaluation_retrieval(spark, sf):
    return summaries.retrieval(_evaluated(spark, sf))


_ANSWERED = (
    "u as (select user_id as item_id, count(*) as tool_call_count, count(*) filter (where event_type = 'error') as errors, count(*) filter (where event_type = 'signup') as n_gold_pmids, greatest(count(*) filter (where event_type = 'view') - 30, 0) as n_gold_claims, count(*) filter (where event_type = 'purchase') as bought, count(*) filter (where event_type = 'click') as clicked from events where user_id is not null group by 1), "
    f"an as (select item_id, (['{_TYPES[0]}', '{_TYPES[1]}', '{_TYPES[2]}', '{_TYPES[3]}'])[item_id % 4 + 1] as question_type, case when item_id % 5 = 0 then 'no_answer' else 'graph_positive' end as expected_answer_type, errors < 45 as success, clicked % 3 <> 0 as json_parse_success, tool_call_count, n_gold_pmids, n_gold_claims, (bought > 40)::int as pmid_hit, least(bought / n_gold_pmids, 1) as pmid_recall, (clicked > 40)::int as claim_hit, "
    "case when n_gold_claims > 0 then least(clicked / n_gold_claims, 1) end as claim_recall, bought % 2 = 0 as abstained, case when item_id % 5 = 0 then bought % 2 = 0 end as no_answer_correct from u)"
)


def _answered(spark, sf) -> DataFrame:
    n = lambda x: F.count_if(F.col("event_type") == x)
    u = _t(spark, sf, "events").where("user_id is not null").groupBy(F.col("user_id").alias("item_id")).agg(F.count("*").alias("tool_call_count"), n("error").alias("errors"), n("signup").alias("n_gold_pmids"), F.greatest(n("view") - 30, F.lit(0)).alias("n_gold_claims"), n("purchase").alias("bought"), n("click").alias("clicked"))
    none = F.col("item_id") % 5 == 0
    return u.select(
        "item_id", F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("item_id") % 4 + 1).cast("int")).alias("question_type"), F.when(none, "no_answer").otherwise("graph_positive").alias("expected_answer_type"), (F.col("errors") < 45).alias("success"), (F.col("clicked") % 3 != 0).alias("json_parse_success"), "tool_call_count", "n_gold_pmids", "n_gold_claims",
        (F.col("bought") > 40).cast("int").alias("pmid_hit"), F.least(F.try_divide("bought", "n_gold_pmids"), F.lit(1)).alias("pmid_recall"), (F.col("clicked") > 40).cast("int").alias("claim_hit"), F.when(F.col("n_gold_claims") > 0, F.least(F.try_divide("clicked", "n_gold_claims"), F.lit(1))).alias("claim_recall"), (F.col("bought") % 2 == 0).alias("abstained"), F.when(none, F.col("bought") % 2 == 0).alias("no_answer_correct"),
    )


_PM, _CL = f"{_SOME} and n_gold_pmids > 0", f"{_SOME} and n_gold_claims > 0"


@query(
    f"with {_ANSWERED}, g as (select coalesce(question_type, 'all') as question_type, count(*) as count, round(avg(success::int), 4) as success_rate, round(avg(json_parse_success::int), 4) as json_parse_rate, round(avg(tool_call_count), 2) as avg_tool_calls, count(*) filter (where {_SOME}) as graph_positive_count, count(*) filter (where {_PM}) as pmid_labeled_count, count(*) filter (where {_CL}) as claim_labeled_count, "
    f"count(*) filter (where {_SOME} and not (n_gold_pmids > 0) and not (n_gold_claims > 0)) as external_review_count, {_mean_sql('pmid_hit', _PM)}, {_mean_sql('pmid_recall', _PM)}, {_mean_sql('claim_hit', _CL)}, {_mean_sql('claim_recall', _CL)}, count(*) filter (where {_NONE}) as no_answer_count, round(avg(coalesce(no_answer_correct, false)::int) filter (where {_NONE}), 4) as no_answer_correct, {_mean_sql('abstained::int', _NONE, 'abstention_rate')} from an group by grouping sets ((), (question_type))) "
    "select *, case when graph_positive_count > 0 then case when pmid_labeled_count > 0 then 'pmid_recall' else 'external_review_required' end end as primary_metric from g"
)
def evaluation_answers(spark, sf):
    return summaries.answers(_answered(spark, sf))


@query(f"with {D.processed()}, ev as (select distinct claim_id, pmid from a where pmid <> ''), q as (select ordinal as query_id, claim_id from a where ordinal % 50 = 0) select distinct query_id, pmid from q join ev using (claim_id)")
def evaluation_articles(spark, sf):
    rows = claims.accepted(E._rows(spark, sf))
    return graph.evidence_articles(rows.where("ordinal % 50 = 0").select(F.col("ordinal").alias("query_id"), "claim_id"), rows)


@query("with x as (select decision_id, (decision_id % 97 - 12)::double as s from audit_decisions) select cast(floor(s / 5) * 5 as int)::varchar || '-' || (cast(floor(s / 5) * 5 as int) + 4)::varchar as band, count(*) as n from x group by 1")
def evaluation_bands(spark, sf):
    return _t(spark, sf, "audit_decisions").groupBy(text.score_band((F.col("decision_id") % 97 - 12).cast("double")).alias("band")).agg(F.count("*").alias("n"))


# benchmark items -------------------------------------------------------------------------------------------------------------

_ORDER = "evidence_count desc, confidence desc, subject, object, claim_id"
_DIVERSIFIED = f"""po as (select *, row_number() over (order by {_ORDER}) as pos from m), f1 as (select *, row_number() over (partition by subject order by pos) as k from po), ps as (select claim_id, subject, object, pos from f1 where k = 1 order by pos limit 35), cut as (select case when count(*) = 35 then max(pos) end as c from ps),
    lt as (select po.claim_id, row_number() over (partition by po.subject, po.object order by pos) as k from po, cut where pos > c and not exists (select 1 from ps where ps.subject = po.subject and ps.object = po.object)),
    dv as (select case when ps.claim_id is not null then 1 when lt.k = 1 then 2 else 3 end as part, po.claim_id, po.subject, po.object, po.direction, po.evidence_count, po.confidence, po.pos from po left join ps using (claim_id) left join lt on lt.claim_id = po.claim_id)"""


@query(D.with_merged(f", {_DIVERSIFIED} select part, claim_id, subject, object, evidence_count, confidence from dv"))
def benchmark_seeds(spark, sf):
    """All claims: the 35 strongest of different subjects, further pairs, the others."""
    return benchmarks.diversified(E._merged(spark, sf))


@query(
    D.with_merged(
        f", {_DIVERSIFIED}, r as (select *, row_number() over (order by part, pos) as n from dv), i as (select n, case when n <= 17 then 'description' when n <= 27 then 'evidence_lookup' else 'reason' end as question_type, claim_id, subject, object, direction from r where n <= 37), "
        "pm as (select i.claim_id, string_agg(distinct pmid, ', ' order by pmid) filter (where pmid <> '') as pmids, arg_min(nullif(evidence_snippet, ''), ordinal) as snippet from i join a using (claim_id) group by 1) "
        "select n, question_type, i.claim_id, pmids, 'The graph supports that ' || replace(subject, '_', ' ') || ' has ' || case direction when 'positive' then 'a positive reported effect or association' when 'negative' then 'a negative reported effect or association' when 'neutral' then 'no statistically significant or neutral reported effect' else 'a ' || direction || ' reported effect' end "
        "|| ' on ' || replace(object, '_', ' ') || '. Gold evidence PMID(s): ' || coalesce(pmids, '') || '.' || case when snippet is not null then ' Key source evidence: ' || snippet else '' end as expected_answer from i left join pm using (claim_id)"
    )
)
def benchmark_items(spark, sf):
    rows = claims.accepted(E._rows(spark, sf))
    return benchmarks.items(claims.merged(rows), rows, 50).select("n", "question_type", "claim_id", "pmids", "expected_answer")


# texts -----------------------------------------------------------------------------------------------------------------------


@query(
    "with s as (select fulltext_id, coalesce(nullif(list_filter(map_entries(sections), lambda e: contains(lower(e.key), 'method'))[1].value, ''), body_text, '') as t from full_text) select fulltext_id, coalesce("
    + ", ".join(f"try_cast(nullif(regexp_extract(t, {D.quoted('(?i)' + p)}, 1), '') as bigint)" for p in L.FULL_TEXT_SAMPLE_PATTERNS)
    + ") as sample_size from s"
)
def text_fulltext_samples(spark, sf):
    e = F.filter(F.map_entries("sections"), lambda x: F.lower(x["key"]).contains("method"))
    return _t(spark, sf, "full_text").select("fulltext_id", text.sample_of_full_text(F.get(e, F.lit(0))["value"], F.col("body_text")).alias("sample_size"))


_COMMANDS = "c as (select event_id, case event_id % 5 when 0 then 'cd /w && python scripts/search_' || event_type || '.py \"' || event_type || ' of ' || user_id || '\" --top 5' when 1 then 'python tools/q.py --k ' || user_id when 2 then 'ls -la' when 3 then 'python3 a/b/find.py ' || event_type else 'grep x.py.txt notes' end as command from events where user_id is not null)"


@query(
    f"with {_COMMANDS} select event_id, coalesce(nullif(regexp_extract(command, '(?:^|[\\s''\"/])([^\\s''\"/]+\\.py)(?:[''\"]?)(?:\\s|$)', 1), ''), 'unknown') as script, coalesce(nullif(regexp_extract(command, '\\.py[''\"]?\\s+\"([^\"]*)\"', 1), ''), nullif(regexp_extract(command, '\\.py[''\"]?\\s+([^\\s''\"-]\\S*)', 1), ''), '') as query from c"
)
def transcripts_commands(spark, sf):
    e = _t(spark, sf, "events").where("user_id is not null")
    k, u = F.col("event_id") % 5, F.col("user_id").cast("string")
    command = (
        F.when(k == 0, F.concat(F.lit("cd /w && python scripts/search_"), "event_type", F.lit('.py "'), "event_type", F.lit(" of "), u, F.lit('" --top 5'))).when(k == 1, F.concat(F.lit("python tools/q.py --k "), u))
        .when(k == 2, "ls -la").when(k == 3, F.concat(F.lit("python3 a/b/find.py "), "event_type")).otherwise("grep x.py.txt notes")
    )
    return e.select("event_id", transcripts.script_name(command).alias("script"), transcripts.command_query(command).alias("query"))


@query(
    "with x as (select distinct name from extracted_entities where name is not null), y as (select name, list_sort(list_distinct(list_concat([name], case lower(name) when 'yogurt' then ['yoghurt'] when 'kefir' then ['kephir'] when 'kimchi' then ['kimchee'] when 'kombucha' then ['combucha'] else [] end))) as a from x) select name, array_to_string(a, ';') as aliases from y"
)
def names_aliases(spark, sf):
    return _t(spark, sf, "extracted_entities").where("name is not null").select("name").distinct().select("name", F.array_join(text.aliases_of(F.col("name")), ";").alias("aliases"))


@query(f"with u as (select * from (values (0)) v(x)), {_ANSWERED} select item_id, not (coalesce(success, false) and coalesce(json_parse_success, false) and tool_call_count > 0) as needs_retry, expected_answer_type = 'no_answer' or question_type in ('no_answer', 'out_of_graph') as no_answer from an".replace("u as (select * from (values (0)) v(x)), ", ""))
def evaluation_retries(spark, sf):
    a = _answered(spark, sf)
    return a.select("item_id", transcripts.needs_retry(F.col("success"), F.col("json_parse_success"), F.col("tool_call_count")).alias("needs_retry"), transcripts.is_no_answer(F.col("expected_answer_type"), F.col("question_type")).alias("no_answer"))


@query(f"with {_ANSWERED} select question_type, count(*) filter (where abstained) as not_answerable, count(*) filter (where not abstained) as answerable from (select *, not abstained as x from an) group by 1")
def evaluation_reviewed(spark, sf):
    """Types of question by whether a reviewer would call them answerable."""
    a = _answered(spark, sf).withColumn("verdict", F.when(F.col("abstained"), "not_answerable").otherwise("answerable"))
    return summaries.crossed(a, "question_type", "verdict", ("not_answerable", "answerable"))


@query(f"with {_ANSWERED}, x as (select expected_answer_type, item_id % 5 + 1 as rating from an) select expected_answer_type, count(rating) as n, round(avg(rating), 4) as mean, round(avg((rating >= 4)::int), 4) as share_high from x group by 1")
def evaluation_rated(spark, sf):
    return summaries.rated(_answered(spark, sf).withColumn("rating", F.col("item_id") % 5 + 1), "expected_answer_type", "rating")


@query("select decision_id, round_even((decision_id % 1000) / 8.0, 2)::double as rounded from audit_decisions")
def vectors_rounded(spark, sf):
    """Halves go to the even neighbour."""
    return _t(spark, sf, "audit_decisions").select("decision_id", F.bround((F.col("decision_id") % 1000) / 8.0, 2).alias("rounded"))


@query(f"with {E._LATEST} select coalesce(t.name, '') as publication_type, count(*) as n, count(distinct pm) as n_articles from (select pm, unnest(publication_types) as t from l) group by 1")
def corpus_audit(spark, sf):
    t = E._latest(spark, sf).select("pmid", F.explode("publication_types").alias("t"))
    return t.groupBy(F.coalesce("t.name", F.lit("")).alias("publication_type")).agg(F.count("*").alias("n"), F.countDistinct("pmid").alias("n_articles"))


@query(D.with_merged("select claim_id, subject, object from m order by md5('30|' || claim_id), claim_id limit 30"))
def claims_sampled(spark, sf):
    """A sample, which is what it is for."""
    return claims.sampled(E._merged(spark, sf), "claim_id", 30, "30").select("claim_id", "subject", "object")


@query(f"select 'claims' as src, {D.strip('pmid')} as pmid, subject_name as name from extracted_claims union all select 'entities', {D.strip('pmid')}, name from extracted_entities")
def items_concatenated(spark, sf):
    part = lambda name, c: _t(spark, sf, name).select(F.lit(name[10:]).alias("src"), text.strip(F.col("pmid")).alias("pmid"), F.col(c).alias("name"))
    return part("extracted_claims", "subject_name").unionByName(part("extracted_entities", "name"))


@query(f"with {D.processed()}, {E._NAMES_SQL}, k as (select distinct n from nm) select distinct subject as src, object as dst, direction from a where subject in (select n from k) and object in (select n from k)")
def graph_legacy_edges(spark, sf):
    return graph.legacy_edges(claims.accepted(E._rows(spark, sf)), E._names(spark, sf))


@query(f"with i as ({E.SQL['entities_aliases']}), {D.processed()} select distinct stype as entity_type, subject as name, i.entity_id from a left join i on i.entity_type = a.stype and i.alias = a.subject".replace("with i as", "with i0 as", 1).replace("left join i on i.", "left join i0 i on i."))
def entities_matched(spark, sf):
    names = claims.accepted(E._rows(spark, sf)).select(F.col("subject_type").alias("entity_type"), F.col("subject").alias("name")).distinct()
    return entities.matched(names, entities.alias_lookup(_t(spark, sf, "extracted_entities")))


@query(D.with_merged(", s as (select subject, sum(evidence_count) as e from m group by 1 order by e desc, subject limit 30), o as (select object, sum(evidence_count) as e from m group by 1 order by e desc, object limit 30) select s.subject, o.object, 'no_answer' as expected_answer_type from s, o where not exists (select 1 from m where m.subject = s.subject and m.object = o.object) order by s.e * o.e desc, s.subject, o.object limit 40"))
def benchmark_no_answer(spark, sf):
    return benchmarks.no_answer(E._merged(spark, sf), 40)


_RUNS = "r as (select user_id as item_id, event_id as ordinal, case when event_type in ('view', 'click') then 'text' else 'tool' end as kind, event_type || ' ' || props as t, event_type as name from events where user_id is not null)"


@query(f"with {_RUNS}, f as (select item_id, name, count(*) as n, min(ordinal) as f from r where kind = 'tool' group by 1, 2), g as (select item_id, sum(n)::bigint as n_calls, string_agg(name, ';' order by f) as tools from f group by 1) select item_id, md5(coalesce(string_agg(t, '' order by ordinal) filter (where kind = 'text'), '')) as response, coalesce(max(n_calls), 0) as n_calls, coalesce(max(tools), '') as tools from r left join g using (item_id) group by item_id")
def transcripts_folded(spark, sf):
    kind = F.when(F.col("event_type").isin("view", "click"), "text").otherwise("tool")
    e = _t(spark, sf, "events").where("user_id is not null").select(F.col("user_id").alias("item_id"), F.col("event_id").alias("ordinal"), kind.alias("kind"), F.concat("event_type", F.lit(" "), "props").alias("text"), F.col("event_type").alias("name"))
    return transcripts.folded(e).withColumn("response", F.md5("response"))


@query("with x as (select doc_id, text, strpos(text, '---') as p from documents where text is not null) select doc_id, length(case when p > 0 then regexp_replace(substr(text, 1, p - 1), '^[\\s\\x{a0}]+|[\\s\\x{a0}]+$', '', 'g') else '' end) as system, length(regexp_replace(case when p > 0 then substr(text, p + 3) else text end, '^[\\s\\x{a0}]+|[\\s\\x{a0}]+$', '', 'g')) as user from x")
def text_prompts(spark, sf):
    parts = text.prompt_parts(F.col("text"))
    return _t(spark, sf, "documents").where("text is not null").select("doc_id", F.length(parts["system"]).alias("system"), F.length(parts["user"]).alias("user"))


@query()
def entities_normalised(spark, sf):
    """Foods, strains and outcomes under their rules, which names_food and names_strain compare with SQL."""
    return entities.normalised(_t(spark, sf, "extracted_entities"))


@query(f"with {E._backfilled_sql()} select claim_id, a.ordinal, case when length(trim(evidence_snippet)) = 0 and length(coalesce(snippet, '')) > 0 then snippet else evidence_snippet end as evidence_snippet, length(trim(evidence_snippet)) = 0 and length(coalesce(snippet, '')) > 0 as backfilled from a left join bf using (ordinal)")
def claims_backfilled(spark, sf):
    """Evidence with the best sentence of the article where the record had none."""
    rows = claims.accepted(E._rows(spark, sf))
    return claims.with_snippets(claims.evidence(rows), evidence.backfilled(rows, E._latest(spark, sf))).select("claim_id", "ordinal", "evidence_snippet", "backfilled")
