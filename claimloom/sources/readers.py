"""Readers of the file formats in use. All take explicit schemas; text fields that are empty stay empty and are not null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from claimloom import schemas


def documents(spark: SparkSession, path: str, item: str, *names: str) -> DataFrame:
    """Items of whole-file JSON documents: a bare list of items, or the first list there is under ``names`` (articles, results, papers, selected, items, merged_claims)."""
    names = names or ("articles", "results", "papers", "selected", "items", "merged_claims")
    raw = spark.read.text(path, wholetext=True)
    nested = schemas.as_struct(item)
    bare = F.from_json("value", f"array<{nested}>")
    held = F.from_json("value", ", ".join(f"{n} array<{nested}>" for n in names))
    chosen = F.when(F.ltrim("value").startswith("["), bare).otherwise(F.coalesce(*[held[n] for n in names]))
    return raw.select(F.posexplode(chosen).alias("item_ordinal", "item")).select("item_ordinal", "item.*")


def json_lines(spark: SparkSession, path: str, schema: str, *, key: str | None = None) -> DataFrame:
    """JSON lines. With ``key`` the last line of each key wins, by file and place in it; lines that are no JSON are left out."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    rows = lines.where(F.trim("value") != "").withColumn("_row", F.from_json("value", schema)).where(F.try_parse_json("value").isNotNull())
    if key is None:
        return rows.select("_row.*")
    last = rows.groupBy(F.col(f"_row.{key}").alias("_k")).agg(F.max_by("_row", F.struct("_f", "_b", "_i")).alias("_row"))
    return last.select("_row.*")


def delimited(spark: SparkSession, path: str, schema: str, *, sep: str = ",") -> DataFrame:
    """Columns of delimited text with a header, quotes and line breaks in quotes, by their names and as text; a column the file lacks is null."""
    raw = spark.read.options(header=True, multiLine=True, escape='"', sep=sep, emptyValue="", nullValue="\x00").csv(path)
    return raw.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])


def journals(spark: SparkSession, path: str) -> DataFrame:
    """A journal ranking: semicolons, decimal commas, numbers that can't be read as 0, quartile Q4 where none is given. Of equal titles the last row wins and keeps the first one's place."""
    rows = delimited(spark, path, schemas.JOURNAL, sep=";").withColumn("_i", F.monotonically_increasing_id())
    number = lambda c, kind: F.coalesce(F.replace(F.col(c), F.lit(","), F.lit(".")).try_cast(kind), F.lit(0).cast(kind))
    rows = rows.select(
        "_i", F.trim("Title").alias("title"), "Issn", number("SJR", "double").alias("sjr"), F.coalesce(F.col("`H index`").try_cast("int"), F.lit(0)).alias("h_index"),
        F.coalesce(F.nullif(F.col("`SJR Best Quartile`"), F.lit("")), F.lit("Q4")).alias("quartile"), "Publisher", "Country",
    )
    one = rows.groupBy(F.lower("title").alias("key")).agg(F.max_by(F.struct("title", "Issn", "sjr", "h_index", "quartile", "Publisher", "Country"), "_i").alias("r"), F.min("_i").alias("ordinal"))
    return one.select("key", "r.*", "ordinal").toDF("key", "title", "issn", "sjr", "h_index", "quartile", "publisher", "country", "ordinal")


def journal_statistics(j: DataFrame) -> DataFrame:
    live = F.col("sjr") > 0
    return j.agg(F.count("*").alias("n"), F.max(F.when(live, F.col("sjr"))).alias("highest"), F.min(F.when(live, F.col("sjr"))).alias("lowest"), F.round(F.avg(F.when(live, F.col("sjr"))), 6).alias("mean"), F.count_if(F.col("sjr") >= 10).alias("top"), F.count_if((F.col("sjr") >= 5) & (F.col("sjr") < 10)).alias("excellent"))


def full_text_xml(df: DataFrame, xml: str = "xml") -> DataFrame:
    """pmid, title, abstract, section titles and body of article XML; a body without sections gives its paragraphs."""
    x = F.col(xml)
    text = lambda path: F.trim(F.regexp_replace(F.xpath_string(x, F.lit(path)), r"\s+", " "))
    titles = F.xpath(x, F.lit("//body//sec/title/text()"))
    paragraphs = F.xpath(x, F.lit("//body//sec/p/text()"))
    return df.withColumns(
        {
            "pmid": text("//article-id[@pub-id-type='pmid']"),
            "title": text("//article-title"),
            "abstract": text("//abstract"),
            "section_titles": titles,
            "body_text": F.trim(F.array_join(F.when(F.size(paragraphs) > 0, paragraphs).otherwise(F.xpath(x, F.lit("//body//p/text()"))), "\n\n")),
        }
    ).drop(xml)


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    """An index kept as parallel arrays, one row a vector: ``id``, ``text``, ``embedding``."""
    raw = spark.read.schema(schemas.EMBEDDINGS).json(path, multiLine=True)
    return raw.select(F.explode(F.arrays_zip("ids", "texts", "embeddings")).alias("x")).select(F.col("x.ids").alias("id"), F.col("x.texts").alias("text"), F.col("x.embeddings").alias("embedding"))
