"""Queries of readers, writers and streams: tables are written in a format and must come back as what SQL makes of the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import text, vectors
from claimloom.operators import graph
from claimloom.plans import dialect as D
from claimloom.plans import evidence as E
from claimloom.plans.evidence import _t, query
from claimloom.session import shared_dir
from claimloom.sources import readers, writers
from claimloom.streaming import incremental


def _at(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/claimloom/{name}-{uuid.uuid4().hex}"


@query("select claim_row_id::varchar as claim_row_id, coalesce(subject_name, '') as subject_name, coalesce(evidence_snippet, '') as evidence_snippet from extracted_claims")
def source_delimited(spark, sf):
    """Quotes, separators and line breaks in fields survive; what is null comes back empty."""
    at = _at(spark, "delimited")
    rows = _t(spark, sf, "extracted_claims").select(F.col("claim_row_id").cast("string"), "subject_name", "evidence_snippet").na.fill("")
    writers.delimited(rows, at)
    return readers.delimited(spark, at, "claim_row_id string, subject_name string, evidence_snippet string").select("claim_row_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("subject_name", "evidence_snippet")])


@query("select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events where user_id is not null group by user_id")
def source_json_lines(spark, sf):
    """Of equal keys the last line wins."""
    at = _at(spark, "lines")
    writers.json_lines(_t(spark, sf, "events").where("user_id is not null").select("event_id", "user_id", "event_type").orderBy("event_id"), at)
    return readers.json_lines(spark, at, "event_id bigint, user_id bigint, event_type string", key="user_id").select("user_id", "event_id", "event_type")


@query("select source, target_share, max_repeats from mix_targets")
def source_document(spark, sf):
    """A document of items beside other fields."""
    at = _at(spark, "document")
    writers.payload(_t(spark, sf, "mix_targets"), at, "items", version=1)
    return readers.documents(spark, at, "source string, target_share double, max_repeats int").select("source", "target_share", "max_repeats")


@query("select fulltext_id, coalesce(pmid, '') as pmid, trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g')) as title, 'Methods' as section_titles, 'First part.' || chr(10) || chr(10) || 'Second part.' as body_text from full_text where not regexp_matches(coalesce(title, ''), '[^\\x20-\\x7e]')")
def source_article_xml(spark, sf):
    """Articles written as XML; titles in plain letters, as white space of other kinds is a matter of taste."""
    safe = lambda c: F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    rows = _t(spark, sf, "full_text").where(~F.coalesce("title", F.lit("")).rlike(r"[^\x20-\x7e]"))
    xml = F.concat(F.lit("<article><front><article-id pub-id-type='pmid'>"), safe("pmid"), F.lit("</article-id><article-title>"), safe("title"), F.lit("</article-title></front><body><sec><title>Methods</title><p>First part.</p><p>Second part.</p></sec></body></article>"))
    return readers.full_text_xml(rows.select("fulltext_id", xml.alias("xml"))).select("fulltext_id", "pmid", "title", F.array_join("section_titles", ";").alias("section_titles"), "body_text")


@query("select vec_id::varchar as id, label::varchar as text, round(embedding[1]::double, 6) as first_number, len(embedding) as n from embeddings where vec_id < 200")
def source_embeddings(spark, sf):
    """An index kept as parallel arrays, which is one document."""
    at = _at(spark, "index")
    e = _t(spark, sf, "embeddings").where("vec_id < 200").select(F.struct("vec_id", F.col("vec_id").cast("string").alias("i"), F.col("label").cast("string").alias("t"), "embedding").alias("r"))
    one = e.agg(F.array_sort(F.collect_list("r")).alias("r")).select(F.col("r.i").alias("ids"), F.col("r.t").alias("texts"), F.col("r.embedding").alias("embeddings"))
    one.write.json(at)
    return readers.embeddings(spark, at).select("id", "text", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first_number"), F.size("embedding").alias("n"))


_RANKED = (("Gut Ecology", "4,25", "80", "Q1"), ("Dairy", "0,7", "", ""), ("Annals", "12,5", "201", "Q1"), ("gut ecology", "5,5", "81", "Q2"), ("No Number", "n/a", "3", "Q3"))


def _ranking(spark) -> DataFrame:
    at = _at(spark, "ranking")
    head = "Rank;Sourceid;Title;Type;Issn;SJR;SJR Best Quartile;H index;Publisher;Country"
    lines = [head, *(f'{i};{i};"{t}";journal;"1234";{s};{q};{h};"Press";"Nowhere"' for i, (t, s, h, q) in enumerate(_RANKED))]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(at)
    return readers.journals(spark, at)


@query("select 4 as n, 12.5::double as highest, 0.7::double as lowest, round((5.5 + 0.7 + 12.5) / 3, 6)::double as mean, 1 as top, 1 as excellent")
def source_journal_statistics(spark, sf):
    """Of equal titles the last row counts; numbers that can't be read are 0 and no rank."""
    return readers.journal_statistics(_ranking(spark))


@query(D.with_merged("select 'links' as part, count(*) as n from (select distinct subject_type || '_' || subject, claim_id, 1 from m union select distinct object_type || '_' || object, claim_id, 2 from m) union all select 'nodes', (select count(*) from m) + (select count(*) from (select subject_type, subject from m union select object_type, object from m))"))
def sink_node_link(spark, sf):
    m, at = E._merged(spark, sf), _at(spark, "node-link")
    writers.node_link(graph.nodes(m), graph.edges(m), at)
    return spark.read.text(f"{at}/*").select(F.regexp_extract("_metadata.file_path", r"/(nodes|links)/", 1).alias("part")).groupBy("part").agg(F.count("*").alias("n"))


@query("select a.fulltext_id, coalesce(a.title, '') <> '' as titled from full_text a where trim(coalesce(a.title, '')) <> '' or trim(coalesce(a.abstract, '')) <> ''")
def sink_training_lines(spark, sf):
    at = _at(spark, "training")
    writers.training_lines(_t(spark, sf, "full_text"), _t(spark, sf, "full_text").where("fulltext_id % 2 = 0").select("fulltext_id", F.lit("even").alias("label")), at, key="fulltext_id")
    known = _t(spark, sf, "full_text").select("fulltext_id", (F.coalesce("title", F.lit("")) != "").alias("titled"))
    return readers.json_lines(spark, at, "fulltext_id bigint, text string, label string").join(known, "fulltext_id").select("fulltext_id", "titled")


@query("select count(distinct pmid) as n from (select regexp_replace(pmid, '^[\\s\\x{a0}]+|[\\s\\x{a0}]+$', '', 'g') as pmid from extracted_claims) c where pmid is not null and not exists (select 1 from articles a where regexp_replace(a.pmid, '^[\\s\\x{a0}]+|[\\s\\x{a0}]+$', '', 'g') = c.pmid)")
def source_unfinished(spark, sf):
    """Articles of claims that the table of articles does not hold."""
    at = lambda name: _t(spark, sf, name).select(text.strip(F.col("pmid")).alias("pmid")).where("pmid is not null")
    return writers.unfinished(at("extracted_claims").distinct(), at("articles"), "pmid").agg(F.count("*").alias("n"))


@query(
    "with x as (select a.vec_id, a.title, b.title as other from abstract_embeddings_bge_m3 a join abstract_embeddings_bge_m3 b on b.vec_id = a.vec_id + 1), t as (select *, list_distinct(string_split(lower(title), '_')) as a, list_distinct(string_split(lower(other), '_')) as b from x where title is not null and other is not null and title <> '' and other <> '') "
    "select vec_id, round(case when contains(lower(title), lower(other)) or contains(lower(other), lower(title)) then greatest(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 0.75) else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) end, 6) as similarity from t"
)
def vectors_lexical(spark, sf):
    """Lexical similarity of a title and the next one by id."""
    e = _t(spark, sf, "abstract_embeddings_bge_m3").select("vec_id", "title")
    ids = e.select("vec_id").distinct()
    following = ids.select(F.col("vec_id").alias("v")).join(ids.select((F.col("vec_id") - 1).alias("v"), F.col("vec_id").alias("w")), "v")
    j = following.join(e.select(F.col("vec_id").alias("v"), F.col("title").alias("x")), "v").join(e.select(F.col("vec_id").alias("w"), F.col("title").alias("y")), "w")
    j = j.where("x is not null and y is not null and x <> '' and y <> ''")
    return j.select(F.col("v").alias("vec_id"), F.round(vectors.name_similarity(F.col("x"), F.col("y")), 6).alias("similarity"))


@query("with w as (select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events where ts is not null group by 1, 2) select * from w where start + interval 1 hour <= (select max(ts) - interval 2 hour from events)")
def stream_closed_windows(spark, sf):
    """Events as a stream: windows come out once the watermark, two hours behind the latest event, has passed their end."""
    return incremental.closed_windows(spark, f"{sf}/events.parquet", "ts is not null").withColumn("total", F.round("total", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))
