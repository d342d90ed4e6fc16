"""Queries of the training-data problems and, where SQL can express them, what they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimloom.llm import canonical, consensus, duplicates, mixing, neighbours, packing, quality, sentences
from claimloom.session import ship, spread


#: Tables that grow; the others are small and fixed.
GROWING = ("abstract_embeddings_bge_m3", "audit_decisions", "documents", "extracted_claims", "extracted_entities", "full_text", "raw_claims")


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df) if name in GROWING else df


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.found(_t(spark, sf, "extracted_claims"), _t(spark, sf, "extracted_entities"), _t(spark, sf, "canonical_entities"))


def p1_misses(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.misses(_t(spark, sf, "extracted_claims"), _t(spark, sf, "extracted_entities"), _t(spark, sf, "canonical_entities"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.found(_t(spark, sf, "extracted_claims"), _t(spark, sf, "raw_claims"))


def p5_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    """Every record of both tables, once with its number of copies."""
    return duplicates.collapsed(_t(spark, sf, "extracted_claims"), _t(spark, sf, "raw_claims"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.found(_t(spark, sf, "abstract_embeddings_bge_m3"))


def p2_recall(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.recall(_t(spark, sf, "abstract_embeddings_bge_m3"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.found(_t(spark, sf, "full_text"), _t(spark, sf, "extracted_claims"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.found(_t(spark, sf, "audit_decisions"))


def p6_items(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.labelled(_t(spark, sf, "audit_decisions"))


def p6_reviewers(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.reviewers(_t(spark, sf, "audit_decisions"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return quality.found(_t(spark, sf, "documents"))


def p9_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judged(_t(spark, sf, "documents"))


def p9_functions(spark: SparkSession, sf: str) -> DataFrame:
    return quality.accuracies(_t(spark, sf, "documents"))


def p7_packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed(_t(spark, sf, "documents"), _t(spark, sf, "container_specs"))


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill(p7_packed(spark, sf), _t(spark, sf, "container_specs"))


def p8_mixed(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixed(_t(spark, sf, "documents"), _t(spark, sf, "mix_targets"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(_t(spark, sf, "documents"), _t(spark, sf, "mix_targets"))


_ALL: tuple[Callable[[SparkSession, str], DataFrame], ...] = (p1_found, p1_misses, p5_found, p5_collapsed, p2_found, p2_recall, p3_found, p6_found, p6_items, p6_reviewers, p7_packed, p7_fill, p8_mixed, p8_shares, p9_found, p9_statistics, p9_functions)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(f):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship(spark)
            return f(spark, sf)

        return run

    return {f.__name__: shipped(f) for f in _ALL}


def _collapsed_sql() -> str:
    """Groups by the key itself, not by its digest; fields of the raw records by JSON functions or one pattern a field."""
    names = "|".join(duplicates.FIELDS)
    bare = lambda c: f"lower(upper(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')))"
    noted = lambda f: f"regexp_extract(record_text, '(?is)(?:^|[;|])\\s*{f}\\s*[:=]\\s*(.*?)\\s*(?:[;|]\\s*(?:{names})\\s*[:=]|$)', 1)"
    raw = lambda f: f"case when starts_with(ltrim(record_text), '{{{{') then case when json_valid(record_text) then json_extract_string(record_text, '$.{f}') end else {noted(f)} end".replace("{{", "{")
    rows = lambda src, i, field, table: f"select '{src}' as src, {i} as id, regexp_replace(pmid, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') as g, " + ", ".join(f"{bare(field(f))} as f{k}" for k, f in enumerate(duplicates.FIELDS)) + f" from {table}"
    every = rows("extracted_claims", "claim_row_id", str, "extracted_claims") + " union " + rows("raw_claims", "raw_id", raw, "raw_claims")
    whole = "coalesce(g <> '' and f0 <> '' and f1 <> '' and f2 <> '', false)"
    return f"with e as ({every}) select src, min(id) as keep_id, count(*) as copies from e where id is not null and {whole} group by src, g, f0, f1, f2 union all select distinct src, id, 1::bigint from e where id is not null and not {whole}"


def oracle_sql() -> dict[str, str]:
    return {"p5_collapsed": _collapsed_sql()}
