"""Entity names brought together: exact and alias matches, and greedy merging in the order of first sight."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions import text
from claimloom.session import written


def first_seen(entities: DataFrame) -> DataFrame:
    """One row for each type and normalised name: the spelling first seen, its id, and how many records have it."""
    key = text.clean_format(F.lower(text.strip(F.coalesce("name", F.lit("")))))
    rows = entities.select("entity_id", text.norm(F.col("entity_type")).alias("entity_type"), key.alias("key"), "name").where("key <> ''")
    return rows.groupBy("entity_type", "key").agg(F.min("entity_id").alias("first_id"), F.min_by("name", "entity_id").alias("canonical"), F.count("*").alias("n"))


def alias_lookup(entities: DataFrame) -> DataFrame:
    """Every normalised name or alias with the entity that had it first. Records without names or aliases add none."""
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = entities.select("entity_id", text.norm(F.col("entity_type")).alias("entity_type"), F.explode(names).alias("alias"))
    rows = rows.withColumn("alias", text.clean_format(F.lower(text.strip(F.col("alias"))))).where("alias <> ''")
    return rows.groupBy("entity_type", "alias").agg(F.min("entity_id").alias("entity_id"), F.count("*").alias("n"))


def matched(names: DataFrame, index: DataFrame) -> DataFrame:
    """Names (``entity_type``, ``name``) with the entity of their type that has them as name or alias, regardless of case and spacing; null where none has. ``index`` is ``alias_lookup``."""
    key = text.clean_format(F.lower(text.strip(F.col("name"))))
    return names.withColumn("alias", key).join(index.select("entity_type", "alias", "entity_id"), ["entity_type", "alias"], "left").select("entity_type", "name", "entity_id")


def normalised(entities: DataFrame) -> DataFrame:
    """Entities under their normalised names by type, foods that can't be foods left out and counted: ``entity_id``, ``entity_type``, ``canonical``, ``skipped``."""
    kind = text.norm(F.col("entity_type"))
    name = F.when(kind == "food", text.food_name(F.col("name"))).when(kind == "strain", text.strain_name(F.col("name"))).otherwise(text.clean_format(F.lower(text.strip(F.col("name")))))
    rows = entities.where("name is not null and name <> ''").select("entity_id", kind.alias("entity_type"), name.alias("canonical"))
    return rows.withColumn("skipped", (F.col("entity_type") == "food") & ~text.food_is_valid(F.col("canonical")))


def merged_greedily(names: DataFrame, pairs: DataFrame, *, least: float = 0.92, types: tuple[str, ...] = ("food", "outcome")) -> DataFrame:
    """Canonical names as one pass in order of first sight gives them.

    ``names``: entity_type, key, first_id; ``pairs``: entity_type, entity_a, entity_b, similarity. A name joins the most similar
    earlier canonical name, of equally similar ones the first seen, if their similarity is at least ``least``, else it is
    canonical itself. Names of other types than ``types`` stay as they are.

    A name can be decided as soon as all earlier names like it are, so every round decides, all over the table, the names whose
    earlier neighbours are decided; the others wait. There are as many rounds as the longest chain of names that each wait for the
    one before (few, as it has to follow the order of first sight), and no cluster is brought together in a task.
    """
    close = pairs.where((F.col("similarity") >= least) & F.col("entity_type").isin(*types)).select("entity_type", "entity_a", "entity_b", "similarity")
    both = close.select("entity_type", F.col("entity_a").alias("key"), F.col("entity_b").alias("other"), "similarity").unionByName(close.select("entity_type", F.col("entity_b").alias("key"), F.col("entity_a").alias("other"), "similarity")).distinct()
    seen = names.select("entity_type", "key", "first_id")
    place = lambda k: F.struct(F.col(f"{k}_id").alias("i"), F.col(k).alias("k"))
    j = both.join(seen.withColumnRenamed("first_id", "key_id"), ["entity_type", "key"]).join(seen.select("entity_type", F.col("key").alias("other"), F.col("first_id").alias("other_id")), ["entity_type", "other"])
    waiting = written(j.where(place("other") < place("key")).select("entity_type", "key", "other", "other_id", "similarity"), "earlier-names")
    linked = both.select("entity_type", "key").distinct()
    done = written(linked.join(waiting, ["entity_type", "key"], "left_anti").withColumn("canonical", F.col("key")), "decided-names")
    rounds = [done]
    while not waiting.isEmpty():
        known = reduce(DataFrame.unionByName, rounds).select("entity_type", F.col("key").alias("other"), (F.col("canonical") == F.col("key")).alias("stands"))
        stand = F.when(F.col("stands"), F.struct((-F.col("similarity")).alias("s"), F.col("other_id").alias("i"), F.col("other").alias("o")))
        ready = waiting.join(known, ["entity_type", "other"], "left").groupBy("entity_type", "key").agg(F.count_if(F.col("stands").isNull()).alias("open"), F.min(stand).alias("best")).where("open = 0")
        done = written(ready.select("entity_type", "key", F.coalesce("best.o", "key").alias("canonical")), "decided-names")
        rounds.append(done)
        waiting = written(waiting.join(done.select("entity_type", "key"), ["entity_type", "key"], "left_anti"), "waiting-names")
    decided = reduce(DataFrame.unionByName, rounds)
    return names.select("entity_type", "key").join(decided, ["entity_type", "key"], "left").withColumn("canonical", F.coalesce("canonical", "key"))
