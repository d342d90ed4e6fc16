"""The claim-centred graph as two DataFrames, its look-ups and its edits.

Edits are copy-on-write: a table of edits changes the claims, and nodes and edges are built again from them. Claim ids stay as
they are when entities are merged or renamed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from claimloom.functions.text import clean_format, name_words, node_id, strip
from claimloom.functions.vectors import name_similarity
from claimloom.session import written


def entities(merged: DataFrame) -> DataFrame:
    """``entity_type``, ``name`` of all subjects and objects, and in how many claims each is."""
    ends = merged.select(F.explode(F.array(F.struct(F.col("subject_type").alias("entity_type"), F.col("subject").alias("name"), F.lit(1).alias("s")), F.struct(F.col("object_type").alias("entity_type"), F.col("object").alias("name"), F.lit(0).alias("s")))).alias("e"))
    return ends.groupBy("e.entity_type", "e.name").agg(F.sum("e.s").alias("as_subject"), (F.count("*") - F.sum("e.s")).alias("as_object"))


def nodes(merged: DataFrame) -> DataFrame:
    """Claim nodes by claim id and entity nodes by type and name."""
    claim = merged.select(F.col("claim_id").alias("node_id"), F.lit("claim").alias("node_type"), F.lit(None).cast("string").alias("entity_type"), F.col("claim_text").alias("name"))
    entity = entities(merged).select(node_id(F.col("entity_type"), F.col("name")).alias("node_id"), F.lit("entity").alias("node_type"), "entity_type", "name")
    return claim.unionByName(entity)


def edges(merged: DataFrame) -> DataFrame:
    """Subject to claim and claim to object. Each claim is read once."""
    pair = lambda a, b, r: F.struct(a.alias("src"), b.alias("dst"), F.lit(r).alias("relation"))
    both = F.array(pair(node_id(F.col("subject_type"), F.col("subject")), F.col("claim_id"), "subject_of"), pair(F.col("claim_id"), node_id(F.col("object_type"), F.col("object")), "affects"))
    return merged.select(F.explode(both).alias("e")).select("e.src", "e.dst", "e.relation").distinct()


def statistics(merged: DataFrame) -> DataFrame:
    """Counts of nodes by type, of claims and of edges: rows of measure and n."""
    by_type = entities(merged).groupBy("entity_type").agg(F.count("*").alias("n")).select(F.concat(F.lit("nodes:"), "entity_type").alias("measure"), "n")
    claims = merged.agg(F.count("*").alias("n"), (F.count("*") * 2).alias("e"), F.sum(F.when(F.col("evidence_count") > 1, 1).otherwise(0)).alias("m"), F.sum("evidence_count").alias("v"))
    flat = claims.select(F.expr("stack(4, 'claims', n, 'edges', e, 'multi_evidence', m, 'evidence', v) as (measure, n)"))
    return by_type.unionByName(flat)


def details(merged: DataFrame, ids: DataFrame) -> DataFrame:
    """Asked ids (``claim_id``) with what the graph knows of them; ``found`` says whether it does."""
    known = merged.select("claim_id", "subject", "subject_type", "object", "object_type", "direction", "evidence_count", F.lit(True).alias("found"))
    return ids.select("claim_id").distinct().join(known, "claim_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def neighbours(merged: DataFrame) -> DataFrame:
    """For every entity its claims with the entity at the other end, as subject and as object."""
    a = merged.select(F.col("subject").alias("entity"), F.col("subject_type").alias("entity_type"), F.lit("as_subject").alias("role"), "claim_id", F.col("object").alias("other"), "direction")
    b = merged.select(F.col("object").alias("entity"), F.col("object_type").alias("entity_type"), F.lit("as_object").alias("role"), "claim_id", F.col("subject").alias("other"), "direction")
    return a.unionByName(b)


def by_article(rows: DataFrame) -> DataFrame:
    """For every pmid the number of its claims and their ids, in order."""
    return rows.groupBy("pmid").agg(F.countDistinct("claim_id").alias("claim_count"), F.array_join(F.array_sort(F.collect_set("claim_id")), ";").alias("claim_ids"))


def compared(merged: DataFrame, sets: DataFrame) -> DataFrame:
    """For sets of claim ids (``set_id``, ``claim_id``): how many are known, whether they share subject or object, whether directions conflict."""
    joined = sets.join(merged.select("claim_id", "subject", "object", "direction"), "claim_id")
    return joined.groupBy("set_id").agg(
        F.countDistinct("claim_id").alias("found_claims"),
        (F.countDistinct("subject") == 1).alias("shared_subject"),
        (F.countDistinct("object") == 1).alias("shared_object"),
        (F.bool_or(F.col("direction") == "positive") & F.bool_or(F.col("direction") == "negative")).alias("conflict"),
    )


def conflicts(merged: DataFrame) -> DataFrame:
    """Pairs of subject and object with claims of opposed directions."""
    d = lambda x: F.count_if(F.col("direction") == x)
    return merged.groupBy("subject", "object").agg(d("positive").alias("n_positive"), d("negative").alias("n_negative"), F.sum("evidence_count").alias("evidence_count")).where("n_positive > 0 and n_negative > 0")


def similar_names(names: DataFrame, *, threshold: float = 0.6, parts: Callable[[Column], Column] = name_words) -> DataFrame:
    """Pairs of names of one type whose words have a Jaccard similarity of at least ``threshold``, each once.

    ``names`` has entity_type and name. Names meet only on their rarest words: of n words, two sets that similar share one of
    the n - ceil(threshold * n) + 1 rarest (prefix filter), so a frequent word brings nobody together.
    """
    sets = names.select("entity_type", "name", parts(F.col("name")).alias("w")).where("size(w) > 0").distinct()
    words = sets.select("entity_type", "name", F.size("w").alias("n"), F.explode("w").alias("word"))
    often = words.groupBy("word").agg(F.count("*").alias("df"))
    ranked = words.join(often, "word").groupBy("entity_type", "name").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("r"))
    keep = F.size("r") - F.ceil(F.lit(threshold) * F.size("r")).cast("int") + 1
    prefix = ranked.select("entity_type", "name", F.transform("r", lambda x: x["word"]).alias("w"), F.explode(F.transform(F.slice("r", F.lit(1), keep), lambda x: x["word"])).alias("key"))
    a, b = prefix.alias("a"), prefix.alias("b")
    size_fits = (F.size("a.w") >= F.lit(threshold) * F.size("b.w")) & (F.size("b.w") >= F.lit(threshold) * F.size("a.w"))
    pairs = a.join(b, (F.col("a.entity_type") == F.col("b.entity_type")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.name") < F.col("b.name")) & size_fits)
    score = F.size(F.array_intersect("a.w", "b.w")) / F.size(F.array_union("a.w", "b.w"))
    return pairs.select(F.col("a.entity_type"), F.col("a.name").alias("entity_a"), F.col("b.name").alias("entity_b"), F.round(score, 6).alias("similarity")).where(F.col("similarity") >= threshold).distinct()


def _grams(c: Column, n: int) -> Column:
    """All stretches of ``n`` characters, each once."""
    last = F.length(c) - n + 1
    return F.array_distinct(F.transform(F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(c, i, n)))


def contained_names(names: DataFrame) -> DataFrame:
    """Pairs of names of one type of which one contains the other, anywhere and regardless of case, each once.

    A contained name meets the others on its rarest three characters, or as a whole if it is shorter; every name is there under
    all its stretches of one to three characters.
    """
    rows = names.select("entity_type", "name", F.lower("name").alias("low")).where("low <> ''").distinct()
    three = rows.select("entity_type", "name", "low", F.explode(_grams(F.col("low"), 3)).alias("gram"))
    often = three.groupBy("entity_type", "gram").agg(F.count("*").alias("df"))
    rarest = three.join(often, ["entity_type", "gram"]).groupBy("entity_type", "name", "low").agg(F.min_by("gram", F.struct("df", "gram")).alias("gram"))
    inner = rarest.unionByName(rows.where("length(low) < 3").withColumn("gram", F.col("low")))
    outer = three.unionByName(rows.select("entity_type", "name", "low", F.explode(F.concat(_grams(F.col("low"), 1), _grams(F.col("low"), 2))).alias("gram")).join(inner.where("length(low) < 3").select("entity_type", "gram").distinct(), ["entity_type", "gram"], "left_semi"))
    a, b = inner.alias("a"), outer.alias("b")
    pairs = a.join(b, (F.col("a.entity_type") == F.col("b.entity_type")) & (F.col("a.gram") == F.col("b.gram")) & (F.col("a.name") != F.col("b.name")) & F.col("b.low").contains(F.col("a.low")))
    return pairs.select(F.col("a.entity_type"), F.least("a.name", "b.name").alias("entity_a"), F.greatest("a.name", "b.name").alias("entity_b")).distinct()


def candidate_names(names: DataFrame, *, least: float = 0.45) -> DataFrame:
    """Pairs of names of one type whose ``name_similarity`` is at least ``least``, each once: parts between underscores in common, or one name within the other."""
    pairs = similar_names(names, threshold=least, parts=lambda c: F.array_distinct(F.split(F.lower(c), "_"))).drop("similarity")
    if least <= 0.75:  # what a name within another is raised to
        pairs = pairs.unionByName(contained_names(names)).distinct()
    return pairs.withColumn("similarity", F.round(name_similarity(F.col("entity_a"), F.col("entity_b")), 6)).where(F.col("similarity") >= least)


def orphans(merged: DataFrame, names: DataFrame) -> DataFrame:
    """Entities (``entity_type``, ``name``) that no claim has as subject or object, regardless of case."""
    low = lambda df: df.select("entity_type", F.lower("name").alias("_low")).distinct()
    return names.select("entity_type", "name", F.lower("name").alias("_low")).join(low(entities(merged)), ["entity_type", "_low"], "left_anti").select("entity_type", "name").distinct()


def referenced(merged: DataFrame, names: DataFrame) -> DataFrame:
    """Entities that some claim has as subject or object, regardless of case."""
    low = entities(merged).select("entity_type", F.lower("name").alias("_low")).distinct()
    return names.withColumn("_low", F.lower("name")).join(low, ["entity_type", "_low"], "left_semi").drop("_low")


def _known(merged: DataFrame, others: DataFrame | None) -> DataFrame:
    """``entity_type``, ``name`` and number of claims of all nodes; ``others`` are nodes without claims."""
    known = entities(merged).select("entity_type", "name", (F.col("as_subject") + F.col("as_object")).alias("n_claims"))
    if others is None:
        return known
    return known.unionByName(others.select("entity_type", "name", F.lit(0).cast("bigint").alias("n_claims"))).groupBy("entity_type", "name").agg(F.max("n_claims").alias("n_claims"))


def edit_results(merged: DataFrame, edits: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Every edit (``action``, ``entity_type``, ``name``, ``target``) with whether it can be made and, if not, why.

    A merge needs the entity or its target, a rename an entity and no target of its new name, an entity is deleted only without
    claims, everything else needs the entity. Edits of one table are judged by the graph before any of them.
    """
    known = _known(merged, others)
    e = edits.select("action", "entity_type", "name", "target").distinct()
    known = written(known, "graph-entities")
    own = known.select("entity_type", "name", "n_claims")
    new = known.select("entity_type", F.col("name").alias("target"), F.lit(True).alias("taken"))
    j = e.join(own, ["entity_type", "name"], "left").join(new, ["entity_type", "target"], "left")
    exists, taken, act = F.col("n_claims").isNotNull(), F.coalesce("taken", F.lit(False)), F.col("action")
    why = (
        F.when((act == "merge") & ~exists & ~taken, "neither exists")
        .when(act == "merge", None)
        .when(~act.isin("rename", "retype", "set_name", "mark_out_of_scope", "delete", "delete_orphan"), "unknown action")
        .when(~exists, "no such entity")
        .when((act == "rename") & taken & (F.col("name") != F.col("target")), "new name exists")
        .when(act.isin("delete", "delete_orphan") & (F.col("n_claims") > 0), "has claims")
    )
    return j.select("action", "entity_type", "name", "target", why.isNull().alias("success"), why.alias("reason"))


def _mapping(merged: DataFrame, edits: DataFrame, others: DataFrame | None) -> DataFrame:
    """What each entity becomes by the edits that can be made; of several of one kind the smallest target counts."""
    e = edit_results(merged, edits, others).where("success")
    pick = lambda *a: F.min(F.when(F.col("action").isin(*a), F.col("target")))
    return e.groupBy("entity_type", "name").agg(pick("merge", "rename").alias("to_name"), pick("retype").alias("to_type"), pick("set_name").alias("display"), F.bool_or(F.col("action") == "mark_out_of_scope").alias("out"), F.bool_or(F.col("action").isin("delete", "delete_orphan")).alias("gone"))


def edited_nodes(merged: DataFrame, edits: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Entity nodes after the edits: ``node_id``, ``entity_type``, ``name``, ``display_name`` and ``quality_status``.

    A display name leaves the node's id as it is. A merged entity gives its claims to the target and is gone.
    """
    j = _known(merged, others).join(_mapping(merged, edits, others), ["entity_type", "name"], "left").where("not coalesce(gone, false)")
    kind, name = F.coalesce("to_type", "entity_type"), F.coalesce("to_name", "name")
    rows = j.select(kind.alias("entity_type"), name.alias("name"), "display", F.when(F.col("out"), "out_of_scope").alias("q"))
    return rows.groupBy("entity_type", "name").agg(F.min("display").alias("display_name"), F.min("q").alias("quality_status")).select(node_id(F.col("entity_type"), F.col("name")).alias("node_id"), "entity_type", "name", "display_name", "quality_status")


def edited(merged: DataFrame, edits: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Claims after the edits that can be made (``edit_results``); claim ids stay.

    merge and rename put the target for the name, retype another type for the entity; both change the node that a claim hangs on
    (``subject_id``, ``object_id``). set_name changes the name that claims show and no node id. An entity marked out of scope
    leaves a flag on its claims. An entity with claims can't be deleted.
    """
    e = _mapping(merged, edits, others)
    side = lambda x: e.select(F.col("entity_type").alias(f"{x}_type"), F.col("name").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("to_name", "to_type", "display", "out")])
    joined = merged.join(side("subject"), ["subject_type", "subject"], "left").join(side("object"), ["object_type", "object"], "left")
    flag = lambda x: F.when(F.col(f"{x}_out"), F.concat(F.lit("entity_out_of_scope:"), F.col(f"{x}_type"), F.lit(":"), F.col(x)))
    cols = []
    for x in ("subject", "object"):
        kind, name = F.coalesce(f"{x}_to_type", f"{x}_type"), F.coalesce(f"{x}_to_name", x)
        cols += [node_id(kind, name).alias(f"{x}_id"), kind.alias(f"{x}_type"), F.coalesce(f"{x}_display", name).alias(x)]
    return joined.select("claim_id", *cols, "direction", "evidence_count", "claim_text", F.array_compact(F.array(flag("subject"), flag("object"))).alias("quality_flags"))


def legacy_edges(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Edges from subject to object by bare name, whatever the type, for claims of which both are among the nodes (``names``: name)."""
    known = names.select("name").distinct()
    pairs = rows.select("subject", "object", "direction").distinct()
    return pairs.join(known.withColumnRenamed("name", "subject"), "subject", "left_semi").join(known.withColumnRenamed("name", "object"), "object", "left_semi").select(F.col("subject").alias("src"), F.col("object").alias("dst"), "direction")


def search_entities(queries: DataFrame, names: DataFrame, k: int) -> DataFrame:
    """The k entities most alike each query by name (``query_id``, ``query``): Jaccard of the parts, at least 0.75 if one name contains the other; ties by name.

    Names are compared only if they share a part or one contains the other; with the others the similarity is 0.
    """
    parts = lambda c: F.array_distinct(F.split(F.lower(c), "_"))
    q = queries.select("query_id", clean_format(F.lower(strip(F.coalesce("query", F.lit(""))))).alias("query")).where("query <> ''")
    n = names.select("entity_type", "name").where("name <> ''").distinct()
    asked = q.select(F.lit("q").alias("entity_type"), F.col("query").alias("name")).distinct()
    words_q = asked.select(F.col("name").alias("query"), F.explode(parts(F.col("name"))).alias("part"))
    words_n = n.select("entity_type", "name", F.explode(parts(F.col("name"))).alias("part"))
    pairs = words_q.join(words_n, "part").select("query", "entity_type", "name")
    both = asked.unionByName(n.select(F.lit("q").alias("entity_type"), "name")).distinct()
    held = contained_names(both).select(F.explode(F.array(F.struct(F.col("entity_a").alias("query"), F.col("entity_b").alias("name")), F.struct(F.col("entity_b").alias("query"), F.col("entity_a").alias("name")))).alias("p")).select("p.query", "p.name")
    held = held.join(asked.select(F.col("name").alias("query")), "query", "left_semi").join(n, "name").select("query", "entity_type", "name")
    scored = pairs.unionByName(held).distinct().withColumn("score", F.round(name_similarity(F.col("query"), F.col("name")), 6)).where("score > 0")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "name", "entity_type")
    top = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return q.join(top, "query").select("query_id", "entity_type", "name", "score", "rank")


def entity_info(merged: DataFrame, names: DataFrame, asked: DataFrame) -> DataFrame:
    """For asked entities (``entity_type``, ``name``) what is known: aliases (of ``names``: entity_type, name, alias), claims as subject and object, evidence, and how many claims of each direction."""
    ends = neighbours(merged.select("*")).join(merged.select("claim_id", "evidence_count"), "claim_id")
    d = lambda x: F.count_if(F.col("direction") == x).alias(f"n_{x}")
    known = ends.groupBy("entity_type", F.col("entity").alias("name")).agg(F.count_if(F.col("role") == "as_subject").alias("as_subject"), F.count_if(F.col("role") == "as_object").alias("as_object"), F.sum("evidence_count").alias("evidence"), d("positive"), d("negative"), d("neutral"))
    alias = names.where("alias <> name").groupBy("entity_type", "name").agg(F.array_join(F.array_sort(F.collect_set("alias")), ";").alias("aliases"))
    return asked.select("entity_type", "name").distinct().join(known, ["entity_type", "name"], "left").join(alias, ["entity_type", "name"], "left").withColumn("found", F.col("evidence").isNotNull())


def article_claims(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """Claims of every article with their texts, a row each."""
    return rows.select("pmid", "claim_id").where("pmid <> ''").distinct().join(merged.select("claim_id", "claim_text"), "claim_id").select("pmid", "claim_id", "claim_text")


def top_entities(merged: DataFrame, n: int = 10) -> DataFrame:
    """The n subjects of each type with most claims; ties by name."""
    best = Window.partitionBy("subject_type").orderBy(F.desc("n_claims"), "subject")
    each = merged.groupBy("subject_type", "subject").agg(F.count("*").alias("n_claims"), F.sum("evidence_count").alias("evidence"))
    return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def evidence_articles(hits: DataFrame, rows: DataFrame) -> DataFrame:
    """From retrieved claims (``query_id``, ``claim_id``) to the articles their evidence comes from, a row each."""
    return hits.select("query_id", "claim_id").distinct().join(rows.select("claim_id", "pmid").where("pmid <> ''").distinct(), "claim_id").select("query_id", "pmid").distinct()
