"""Explicit schemas of the logical tables; nothing is inferred when files are read."""

from __future__ import annotations

EVIDENCE = "pmid string, study_type string, effect_size string, p_value string, confidence_interval string, key_finding string, evidence_snippet string, effect_direction string, health_interpretation string, population string, confidence string"
DOSE = "value string, unit string, duration string"
ARTICLE = (
    "pmid string, title string, abstract string, journal string, year string, pmcid string, doi string, publication_types array<struct<name:string>>, "
    "authors_full array<struct<name:string,affiliations:array<string>>>, author_affiliations array<string>, grants array<struct<agency:string,grant_id:string>>, mesh_terms array<string>, keywords array<string>"
)
RAW_CLAIM = (
    "subject string, subject_type string, outcome string, object string, object_type string, direction string, effect_direction string, health_interpretation string, effect_size string, confidence_interval string, "
    "p_value string, evidence_strength string, key_finding string, evidence_snippet string, dose string, duration string, population string"
)
MERGED_CLAIM = (
    "node_type string, claim_id string, claim_text string, subject_type string, subject_name string, object_type string, object_name string, direction string, effect_direction string, health_interpretation string, "
    f"dose_info struct<{DOSE.replace(' string', ':string').replace(', ', ',')}>, evidence_list array<struct<{EVIDENCE.replace(' string', ':string').replace(', ', ',')}>>, evidence_count int, confidence_score double, "
    "merged_from array<string>, first_seen string, last_updated string, quality_flags array<string>"
)
RESULT = "pmid string, title string, success boolean, warnings array<string>, errors array<string>, entities array<struct<name:string,type:string>>"
BENCHMARK_ITEM = (
    "id string, question_type string, question string, expected_answer_type string, expected_answer string, annotation_note string, gold_claim_ids array<string>, gold_pmids array<string>, gold_subjects array<string>, "
    "gold_outcomes array<string>, gold_directions array<string>, retrieval_queries array<string>"
)
AGENT_RESULT = "id string, agent_response string, success boolean, iterations int, error string, tool_calls array<struct<id:string,name:string,input:string>>"
JOURNAL = "Title string, Issn string, SJR string, `H index` string, `SJR Best Quartile` string, Publisher string, Country string"
EMBEDDINGS = "ids array<string>, texts array<string>, embeddings array<array<float>>"


def listed(item: str) -> str:
    """A document that holds items under any of the names in use."""
    nested = as_struct(item)
    return ", ".join(f"{k} array<{nested}>" for k in ("articles", "results", "papers", "selected", "items", "merged_claims"))


def as_struct(fields: str) -> str:
    """Fields of a schema as one struct type."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(fields).simpleString()
