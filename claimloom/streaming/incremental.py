"""Claims that keep arriving: merged state by claim id, and the points at which a run would stop to check itself."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.operators import claims
from claimloom.session import bounded, shared_dir, written


def merge_arrivals(stream: DataFrame, state_path: str, checkpoint: str, *, ordinal: str = "claim_row_id"):
    """Start a query that merges the accepted records of a stream of claims batch by batch under ``state_path``.

    Of each batch the records no earlier batch had, by their ordinal, are counted by claim and article; these counts and the
    ordinals are written under the batch's number, and a batch that is repeated replaces itself, so the result is exactly once. What is kept of
    a record is its number. ``merged_state`` adds the counts up.
    """
    def write(batch: DataFrame, number: int) -> None:
        rows = claims.accepted(claims.processed(batch, ordinal=ordinal)).dropDuplicates(["ordinal"])
        if number:
            seen = batch.sparkSession.read.schema("ordinal bigint, batch int").parquet(f"{state_path}/seen").where(F.col("batch") < number)
            rows = rows.join(seen.select("ordinal"), "ordinal", "left_anti")
        rows = written(rows, "arrivals")
        claims.counted(rows).write.mode("overwrite").parquet(f"{state_path}/counts/batch={number}")
        rows.select(F.col("ordinal").cast("bigint")).write.mode("overwrite").parquet(f"{state_path}/seen/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_state(spark: SparkSession, state_path: str) -> DataFrame:
    """Merged claims of all batches."""
    return claims.finished(claims.united(spark.read.parquet(f"{state_path}/counts").drop("batch")))


def merge_directory(spark: SparkSession, source: str, name: str, *, files_per_batch: int = 1) -> DataFrame:
    """Run over everything a folder of claims holds now, and give the merged claims."""
    at = f"{shared_dir(spark)}/claimloom/{name}-{uuid.uuid4().hex}"
    merge_arrivals(_opened(spark, source, files_per_batch), f"{at}/state", f"{at}/checkpoint").awaitTermination()
    return merged_state(spark, f"{at}/state")


def stops(counts: Iterable[tuple[int, int, int]], *, articles: int = 25, entities: int = 80, warnings: int = 3) -> list[bool]:
    """After which articles a run stops to check itself: as soon as enough articles, new entities or warnings have come together since the last stop, and after the last one. ``counts``: articles, new entities and warnings of each step."""
    out, a, e, w = [], 0, 0, 0
    for x, y, z in counts:
        a, e, w = a + x, e + y, w + z
        hit = a >= articles or e >= entities or w >= warnings
        out.append(hit)
        if hit:
            a = e = w = 0
    if out:
        out[-1] = True
    return out


def check_points(progress: DataFrame, *, block: int = 100_000, articles: int = 25, entities: int = 80, warnings: int = 3) -> DataFrame:
    """``run_id``, ``ordinal``, ``stop`` for the steps of runs (run_id, ordinal, new_entities, warnings), one step an article.

    The counters start over at each stop, so a step depends on all before it. But between two stops there are less than
    ``articles`` steps: all that a block of steps has to know of the past is how many steps ago the last stop was, and the steps
    since. So steps are range-sorted into blocks, each block gives for every such number what it ends with, these short lists
    are followed from block to block, and every block is gone through once more from its true start. No run is one task.
    """
    cols = ["run_id", "ordinal", "new_entities", "warnings"]
    n = progress.count()
    blocks = max(1, -(-n // block))
    rows = written(progress.select(*cols).repartitionByRange(blocks, "run_id", "ordinal").withColumn("block", F.spark_partition_id()), "run-steps")
    ends = Window.partitionBy("block").orderBy(F.desc("run_id"), F.desc("ordinal"))
    tails = bounded(rows.withColumn("_r", F.row_number().over(ends)).where(F.col("_r") < articles).drop("_r"), blocks * articles, "last steps of blocks")
    heads = {r["block"]: r["run_id"] for r in bounded(rows.groupBy("block").agg(F.min("run_id").alias("run_id")), blocks, "blocks")}
    order = sorted(heads)
    before: dict[int, list[tuple]] = {}
    past: list[tuple] = []
    for b in order:  # the steps before each block, as many as can matter
        before[b] = past
        past = (past + sorted((r["run_id"], r["ordinal"], r["new_entities"], r["warnings"]) for r in tails if r["block"] == b))[-(articles - 1) :] if articles > 1 else []
    after = {b: heads[c] for b, c in zip(order, order[1:], strict=False)}
    shared = rows.sparkSession.sparkContext.broadcast((before, after))

    def walk(g: pd.DataFrame, since: int) -> tuple[list[bool], int]:
        """The stops of a block if the last stop was so many steps before it, and the steps since the last stop at its end."""
        b = int(g["block"].iloc[0])
        known, following = shared.value
        run, a, e, w = None, 0, 0, 0
        for r, _, x, y in known[b][len(known[b]) - since :] if since else []:
            a, e, w = (a + 1, e + x, w + y) if r == run else (1, x, y)
            run = r
        out: list[bool] = []
        runs = g["run_id"].tolist()
        for i, (r, x, y) in enumerate(zip(runs, g["new_entities"].tolist(), g["warnings"].tolist(), strict=True)):
            a, e, w = (a + 1, e + x, w + y) if r == run else (1, x, y)
            run = r
            last = runs[i + 1] != r if i + 1 < len(runs) else following.get(b) != r
            stop = last or a >= articles or e >= entities or w >= warnings
            out.append(stop)
            if stop:
                a = e = w = 0
        return out, a

    def ends_of(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["run_id", "ordinal"])
        return pd.DataFrame({"block": int(g["block"].iloc[0]), "since": range(articles), "ends": [walk(g, min(s, len(shared.value[0][int(g["block"].iloc[0])])))[1] for s in range(articles)]})

    ended = {(r["block"], r["since"]): r["ends"] for r in bounded(rows.groupBy("block").applyInPandas(ends_of, "block int, since int, ends int"), blocks * articles, "ends of blocks")} if blocks > 1 else {}
    starts, since = {}, 0
    for b in order:
        starts[b] = since
        since = ended.get((b, since), 0)
    start = rows.sparkSession.sparkContext.broadcast(starts)

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["run_id", "ordinal"])
        return pd.DataFrame({"run_id": g["run_id"], "ordinal": g["ordinal"], "stop": walk(g, start.value[int(g["block"].iloc[0])])[0]})

    return rows.groupBy("block").applyInPandas(one, "run_id string, ordinal bigint, stop boolean")


def _opened(spark: SparkSession, source: str, files_per_batch: int) -> DataFrame:
    """A folder of parquet files, or one file, as a stream."""
    reader = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", files_per_batch)
    where = spark._jvm.org.apache.hadoop.fs.Path(source)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        reader, source = reader.option("pathGlobFilter", where.getName()), where.getParent().toString()
    return reader.parquet(source)


def closed_windows(spark: SparkSession, source: str, where: str = "true", *, files_per_batch: int = 1, **how: str) -> DataFrame:
    """The windows that a stream over everything a folder holds now has closed: those its watermark has passed."""
    at = f"{shared_dir(spark)}/claimloom/windows-{uuid.uuid4().hex}"
    out = windowed_events(_opened(spark, source, files_per_batch).where(where), **how)
    out.writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")


def windowed_events(events: DataFrame, *, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and window, on a stream or a table; on a stream events later than ``late`` are dropped."""
    df = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return df.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
