"""Problem 5: records that are the same but for whitespace, case, punctuation or the order of their fields.

Method: each record gets a 128-bit digest of its canonical key. Keys met more often than ``hot_rows`` are found exactly from
partial counts. Records of hot keys are salted and aggregated on two levels, and only the key's representative, one small row a
hot key, is sent back to them; all other keys take one shuffle. The representative is the record with the smallest id.

A record with a key field that is null or has no letter or digit, or without a group, is no copy of any: ``copies`` and
``collapse`` leave it out, ``records_once`` gives it once, with copies = 1. Records without an id can't be named and are left
out everywhere. Ids that occur twice are the same record delivered twice; they yield one row each. An empty table yields no row. Extra columns are ignored, whatever
their names. Long texts only cost their digest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.session import written

FIELDS = ("subject_name", "object_name", "direction")


def canonical(c: Column) -> Column:
    """Letters and digits only, regardless of case; null where there are none."""
    bare = F.regexp_replace(F.upper(c), r"[^\p{L}\p{N}]+", "")  # in between, or Catalyst takes lower(upper(x)) for lower(x)
    return F.nullif(F.lower(bare), F.lit(""))


def trimmed(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), F.lit(""))


def with_keys(df: DataFrame, id_col: str, group: Column, fields: list[Column]) -> DataFrame:
    """Rows ``id``, ``key`` of all records with an id; the key is null for those that are no copy of any. It is 16 bytes, whatever the record's length."""
    parts = [trimmed(group), *map(canonical, fields)]
    whole = reduce(lambda a, b: a & b, [p.isNotNull() for p in parts])
    return df.select(F.col(id_col).alias("id"), F.when(whole, F.unhex(F.md5(F.concat_ws("\x1f", *parts)))).alias("key")).where("id is not null")


def representatives(records: DataFrame, *, hot_rows: int = 100_000, salts: int = 64) -> DataFrame:
    """``id``, ``key`` and ``keep``, the smallest id of the same key, for all records whose key occurs more than once.

    At most rows / hot_rows keys can be hot, so what is broadcast is small by arithmetic: 10 billion rows leave at most 100,000
    keys of 16 bytes. Where the table of hot keys is larger than Spark's broadcast threshold Catalyst joins by shuffle.
    """
    records = written(records, "keyed-records")  # 24 bytes a record; the texts are read and digested once
    hot = records.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select("key")
    hot = written(hot, "hot-keys")
    if hot.isEmpty():
        return _one_level(records)
    cold = _one_level(records.join(hot, "key", "left_anti"))
    warm = records.join(hot, "key", "left_semi")
    salted = warm.groupBy("key", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).agg(F.min("id").alias("keep"))
    return cold.unionByName(warm.join(salted.groupBy("key").agg(F.min("keep").alias("keep")), "key"))


def _one_level(records: DataFrame) -> DataFrame:
    same = Window.partitionBy("key")
    return records.withColumns({"keep": F.min("id").over(same), "n": F.count("*").over(same)}).where("n > 1").drop("n")


def copies(records: DataFrame, **how: int) -> DataFrame:
    """``keep_id``, ``copy_id`` for every record of a group but the one kept."""
    return representatives(records, **how).where("id <> keep").select(F.col("keep").alias("keep_id"), F.col("id").alias("copy_id")).distinct()


def collapse(records: DataFrame, *, hot_rows: int = 100_000, salts: int = 64) -> DataFrame:
    """One row for each group: ``keep_id`` and ``copies``. Hot keys are counted by salt first, so no task gets a whole group."""
    records = written(records, "keyed-records")
    once = records.groupBy("key", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).agg(F.min("id").alias("keep"), F.count("*").alias("n"))
    hot = records.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select("key")
    hot = written(hot, "hot-keys")
    plain = records if hot.isEmpty() else records.join(hot, "key", "left_anti")
    out = plain.groupBy("key").agg(F.min("id").alias("keep_id"), F.count("*").alias("copies"))
    if not hot.isEmpty():
        out = out.unionByName(once.join(hot, "key", "left_semi").groupBy("key").agg(F.min("keep").alias("keep_id"), F.sum("n").alias("copies")))
    return out.select("keep_id", "copies")


def records_once(records: DataFrame, **how: int) -> DataFrame:
    """``keep_id`` and ``copies`` of every group and, with copies = 1, of every record without a key. Rows delivered twice under one id are one record here, so that copies counts records."""
    records = written(records.distinct(), "all-records")
    groups = collapse(records.where("key is not null"), **how)
    single = records.where("key is null").select(F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("copies"))
    return groups.unionByName(single)


def notation_field(text: Column, name: str) -> Column:
    """A field of a record written as ``name: value | ...`` or ``name=value; ...``, in any order and case of the names."""
    names = "|".join(FIELDS)
    return F.regexp_extract(text, rf"(?is)(?:^|[;|])\s*{name}\s*[:=]\s*(.*?)\s*(?=[;|]\s*(?:{names})\s*[:=]|$)", 1)


def parse_notation(df: DataFrame, text: str = "record_text") -> DataFrame:
    """Add the three named fields of a record kept as text, JSON or not. A text that is neither leaves them null or empty."""
    t = F.col(text)
    fields = F.transform_keys(F.from_json(t, "map<string,string>"), lambda k, _: F.lower(F.trim(k)))
    is_json = F.ltrim(t).startswith("{")
    df = df.drop(*FIELDS).withColumn("_fields", F.when(is_json, fields))
    return df.withColumns({f: F.when(is_json, F.col("_fields")[f]).otherwise(notation_field(t, f)) for f in FIELDS}).drop("_fields")


def all_claims(claims: DataFrame) -> DataFrame:
    return with_keys(claims, "claim_row_id", F.col("pmid"), [F.col(f) for f in FIELDS])


def all_raw(raw: DataFrame) -> DataFrame:
    parsed = parse_notation(raw.select("raw_id", "pmid", "record_text"))
    return with_keys(parsed, "raw_id", F.col("pmid"), [F.col(f) for f in FIELDS])


def claim_records(claims: DataFrame) -> DataFrame:
    return all_claims(claims).where("key is not null")


def raw_records(raw: DataFrame) -> DataFrame:
    return all_raw(raw).where("key is not null")


def collapsed(claims: DataFrame, raw: DataFrame, **how: int) -> DataFrame:
    """``src``, ``keep_id`` and ``copies`` of both tables; every record counts in one row."""
    both = [records_once(r, **how).select(F.lit(src).alias("src"), F.col("keep_id").cast("bigint"), "copies") for src, r in (("extracted_claims", all_claims(claims)), ("raw_claims", all_raw(raw)))]
    return both[0].unionByName(both[1])


def found(claims: DataFrame, raw: DataFrame, **how: int) -> DataFrame:
    """Copies within each of the two tables."""
    both = [copies(r, **how).select(F.lit(src).alias("src"), F.col("keep_id").cast("bigint"), F.col("copy_id").cast("bigint")) for src, r in (("extracted_claims", claim_records(claims)), ("raw_claims", raw_records(raw)))]
    return both[0].unionByName(both[1])
