"""Lexical and vector search over claims, fusion of several searches, and retrieval metrics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from claimloom.functions import lexical
from claimloom.session import ship, written

CUTS = (1, 3, 5, 10, 20)


def ranked(scores: DataFrame, k: int, *, query: str = "query_id", item: str = "item_id") -> DataFrame:
    """The k best items of each query with their rank; equal scores by smaller item. Partial top-k runs before the shuffle."""
    order = Window.partitionBy(query).orderBy(F.col("score").desc(), item)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def lexical_top(queries: DataFrame, items: DataFrame, k: int, *, common: float = 0.05, block: int = 200_000, rows: int = 250_000) -> DataFrame:
    """The k best items of each query, exactly: ``query_id``, ``item_id``, ``score``, ``rank``.

    The score is the overlap of word bags over the product of their norms, plus 0.25 for each of the item's phrases (``phrases``,
    an array) that the query contains; items that share no word have none. ``queries``: query_id, query; ``items``: item_id, text,
    phrases.

    Queries of the same text are asked once. As in ``vector_search``, blocks of about ``block`` queries meet blocks of about
    ``rows`` items in a task each, and only the k best of a block, with what rounding could tie with the kth, leave it; no pair is
    shuffled before. Within a block, words in more than the share ``common`` of its items bring no pair together
    (``functions.lexical``).
    """
    spark = items.sparkSession
    ship(spark)
    it = written(items.where("item_id is not null").select("item_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"), F.coalesce("phrases", F.array().cast("array<string>")).alias("phrases")), "lexical-items")
    q = written(queries.where("query_id is not null").select("query_id", F.lower(F.coalesce("query", F.lit(""))).alias("text")), "lexical-queries")
    asked = written(q.groupBy("text").agg(F.min("query_id").alias("asked_id")), "lexical-texts")
    n_items, n_asked, cores = it.count(), asked.count(), spark.sparkContext.defaultParallelism
    ni, nq = max(1, -(-n_items // rows), min(cores, n_items // 5_000)), max(1, -(-n_asked // block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    ids = {"asked_id": asked.schema["asked_id"].dataType, "item_id": it.schema["item_id"].dataType}
    left = asked.select("asked_id", F.lit(None).cast(ids["item_id"]).alias("item_id"), "text", F.lit(None).cast("array<string>").alias("phrases"), cell("text", nq).alias("_q"), every(ni).alias("_i"))
    right = it.select(F.lit(None).cast(ids["asked_id"]).alias("asked_id"), "item_id", "text", "phrases", every(nq).alias("_q"), cell("item_id", ni).alias("_i"))
    cells = left.unionByName(right).repartitionById(ni * nq, F.col("_i") * nq + F.col("_q")).drop("_q", "_i")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (parts := list(batches)):
            return
        t = pa.Table.from_batches(parts)
        asks, has = t.filter(pc.is_valid(t["asked_id"])), t.filter(pc.is_valid(t["item_id"]))
        one = lambda t, c: t[c].combine_chunks()
        qs, its, scores = lexical.best(one(asks, "text"), one(has, "item_id"), one(has, "text"), one(has, "phrases"), k, common)
        yield from pa.table({"asked_id": asks["asked_id"].take(pa.array(qs)), "item_id": has["item_id"].take(pa.array(its)), "score": scores}).to_batches(max_chunksize=100_000)

    found = cells.mapInArrow(search, T.StructType([T.StructField(c, x) for c, x in ids.items()]).add("score", "double"))
    top = ranked(found.withColumn("score", F.round("score", 6)), k, query="asked_id")
    return q.join(asked, "text").select("query_id", "asked_id").join(top, "asked_id").select("query_id", "item_id", "score", "rank")


def vector_search(queries: DataFrame, items: DataFrame, k: int, *, dim: int, block: int = 4096, rows: int = 65_536) -> DataFrame:
    """The k items of highest cosine for each query, exactly: ``query_id``, ``item_id``, ``score``, ``rank``.

    Queries and items are cut into blocks by a hash of their id, so many that a block holds about ``block`` queries or ``rows``
    items, and each block of queries meets each block of items in one task: a query is sent to every block of items, an item to
    every block of queries. Nothing passes the driver. A task keeps its k best for each query. Vectors that are null, of another
    length, zero or not finite take no part.
    """
    fine = lambda c: (F.size(c) == dim) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(c, lambda x: x != 0)
    side = lambda df, key: df.where(fine(F.col("vector"))).select(F.col(key).cast("bigint").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
    q, it = side(queries, "query_id"), side(items, "item_id")
    nq, ni = max(1, -(-q.count() // block)), max(1, -(-it.count() // rows))
    cell = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    both = q.select(cell(nq).alias("qb"), every(ni).alias("ib"), "id", "vector", F.lit(True).alias("asks")).unionByName(it.select(every(nq).alias("qb"), cell(ni).alias("ib"), "id", "vector", F.lit(False).alias("asks")))

    def search(t: pa.Table) -> pa.Table:
        asks, ids = t.column("asks").to_numpy(), t.column("id").to_numpy()
        x = t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype("f8")
        x = x / np.sqrt((x * x).sum(1, keepdims=True))
        qid, iid, a, b = ids[asks], ids[~asks], x[asks], x[~asks]
        take, out = min(k, len(iid)), []
        step = max(1, 8_000_000 // max(1, len(iid)))
        for s in range(0, len(qid) if take else 0, step):
            sim = np.round(a[s : s + step] @ b.T, 9)
            order = np.lexsort((np.broadcast_to(iid, sim.shape), -sim), axis=1)[:, :take]
            out.append((np.repeat(qid[s : s + step], take), iid[order.ravel()], np.take_along_axis(sim, order, 1).ravel()))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "item_id", "score"), cols, strict=True)))

    return ranked(both.groupBy("qb", "ib").applyInArrow(search, "query_id bigint, item_id bigint, score double"), k)


def fused(scores: DataFrame, k: int) -> DataFrame:
    """The best score of each item over all phrasings of a query (``query_id``, ``item_id``, ``score``), ranked again."""
    return ranked(scores.groupBy("query_id", "item_id").agg(F.max("score").alias("score")), k)


def metrics(hits: DataFrame, gold: DataFrame, cuts: Sequence[int] = CUTS) -> DataFrame:
    """For each query of ``gold`` (query_id, item_id) its reciprocal rank, and hit and recall at each cut; 0 without a hit."""
    g = gold.select("query_id", "item_id").distinct()
    n = g.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    found = hits.select("query_id", "item_id", "rank").join(g, ["query_id", "item_id"], "left_semi")
    at = found.groupBy("query_id").agg(F.min("rank").alias("first"), *[F.count_if(F.col("rank") <= c).alias(f"n{c}") for c in cuts])
    out = n.join(at, "query_id", "left")
    cols = {"reciprocal_rank": F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6)}
    for c in cuts:
        got = F.coalesce(F.col(f"n{c}"), F.lit(0))
        cols |= {f"hit_{c}": (got > 0).cast("int"), f"recall_{c}": F.round(got / F.col("n_gold"), 6)}
    return out.select("query_id", "n_gold", *[v.alias(k) for k, v in cols.items()])


def metric_summary(per_query: DataFrame, kind: str, cuts: Sequence[int] = CUTS) -> DataFrame:
    """Means over all queries and by a kind of query; the row over all has ``all`` for it."""
    means = [F.round(F.avg(c), 6).alias(c) for c in ("reciprocal_rank", *(f"{m}_{c}" for c in cuts for m in ("hit", "recall")))]
    return per_query.rollup(kind).agg(F.count("*").alias("n"), *means).withColumn(kind, F.coalesce(F.col(kind).cast("string"), F.lit("all")))
