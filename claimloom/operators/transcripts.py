"""Recorded agent runs: tool calls, answers, and how they score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import text


def script_name(command: Column) -> Column:
    """The first Python script a shell command names, without its folder; ``unknown`` where there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(command, r"""(?:^|[\s'"/])([^\s'"/]+\.py)(?:['"]?)(?:\s|$)""", 1), F.lit("")), F.lit("unknown"))


def command_query(command: Column) -> Column:
    """What follows the script, quoted or not, unless it is an option."""
    quoted, bare = F.regexp_extract(command, r"""\.py['"]?\s+"([^"]*)\"""", 1), F.regexp_extract(command, r"""\.py['"]?\s+([^\s'"-]\S*)""", 1)
    return F.coalesce(F.nullif(quoted, F.lit("")), F.nullif(bare, F.lit("")), F.lit(""))


def needs_retry(success: Column, parsed: Column, calls: Column) -> Column:
    """A run that failed, gave no JSON or called no tool is to be repeated."""
    return ~(F.coalesce(success, F.lit(False)) & F.coalesce(parsed, F.lit(False)) & (F.coalesce(calls, F.lit(0)) > 0))


def is_no_answer(expected: Column, kind: Column) -> Column:
    """An item that has no answer, by what is expected or by its type."""
    return F.coalesce((expected == "no_answer") | kind.isin("no_answer", "out_of_graph"), F.lit(False))


def folded(events: DataFrame) -> DataFrame:
    """Events of runs (item_id, ordinal, kind, text, name) as one row a run: its texts in order, its number of tool calls and the tools in order of first use. A run is one transcript."""
    said = F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("ordinal", "text"))))
    tools = events.where("kind = 'tool'").groupBy("item_id", "name").agg(F.count("*").alias("n"), F.min("ordinal").alias("first")).groupBy("item_id").agg(F.sum("n").alias("n_calls"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "name"))), lambda x: x["name"]), ";").alias("tools"))
    out = events.groupBy("item_id").agg(F.array_join(F.transform(said, lambda x: x["text"]), "").alias("response"))
    return out.join(tools, "item_id", "left").withColumns({"n_calls": F.coalesce("n_calls", F.lit(0)), "tools": F.coalesce("tools", F.lit(""))})


def call_statistics(calls: DataFrame) -> DataFrame:
    """For each item its calls, distinct commands, repeats of a command, and the command called most. ``calls``: item_id, ordinal, command."""
    each = calls.groupBy("item_id", "command").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))
    return each.groupBy("item_id").agg(F.sum("n").alias("n_calls"), F.count("*").alias("n_commands"), F.sum(F.col("n") - 1).alias("repeats"), F.min_by("command", F.struct(-F.col("n"), F.col("first"))).alias("most_called"))


def call_summary(per_item: DataFrame, kind: str) -> DataFrame:
    """Mean, median, ninth tenth and most calls, overall and by kind. The ninth tenth is the value at place int(0.9 n) of n in order, the last one for n = 1.

    Values are counted before they are ordered, so what is brought together grows with the different values, not the items.
    """
    both = per_item.select("n_calls", F.explode(F.array(F.lit("all"), F.col(kind).cast("string"))).alias("group")).where("group is not null")
    counted = both.groupBy("group", "n_calls").agg(F.count("*").alias("c"))
    from pyspark.sql.window import Window

    upto = Window.partitionBy("group").orderBy("n_calls").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_of = Window.partitionBy("group")
    placed = counted.withColumns({"upto": F.sum("c").over(upto), "n": F.sum("c").over(all_of)})
    spot = F.when(F.col("n") * 9 < 10, F.col("n")).otherwise(F.floor(F.col("n") * 9 / 10))
    at = lambda place: F.min(F.when(F.col("upto") >= place, F.col("n_calls")))
    out = placed.groupBy("group").agg(F.max("n").alias("n"), (F.sum(F.col("c") * F.col("n_calls")) / F.sum("c")).alias("mean"), at(F.floor((F.col("n") + 1) / 2)).alias("lo"), at(F.floor(F.col("n") / 2) + 1).alias("hi"), at(spot).alias("p90"), F.max("n_calls").alias("most"))
    return out.select("group", "n", F.round("mean", 4).alias("mean"), ((F.col("lo") + F.col("hi")) / 2).alias("median"), "p90", "most")


def scored_answers(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """For answers (item_id, response) the cited pmids and claim ids, whether they abstain, and hit and recall against gold pmids; null where an item has none. ``gold``: item_id, pmid."""
    a = answers.select("item_id", text.cited_pmids(F.col("response")).alias("pmids"), text.cited_claims(F.col("response")).alias("claims"), text.abstains(F.col("response")).alias("abstains"))
    hits = a.select("item_id", F.explode("pmids").alias("pmid")).join(gold.select("item_id", "pmid").distinct(), ["item_id", "pmid"], "left_semi").groupBy("item_id").agg(F.count("*").alias("h"))
    n = gold.select("item_id", "pmid").distinct().groupBy("item_id").agg(F.count("*").alias("n"))
    j = a.join(n, "item_id", "left").join(hits, "item_id", "left")
    h = F.coalesce("h", F.lit(0))
    return j.select("item_id", F.size("pmids").alias("n_pmids"), F.size("claims").alias("n_claims"), "abstains", F.when(F.col("n") > 0, h > 0).alias("pmid_hit"), F.when(F.col("n") > 0, F.round(h / F.col("n"), 6)).alias("pmid_recall"))
