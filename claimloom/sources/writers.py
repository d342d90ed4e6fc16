"""Writers. Everything is written by the executors, but for the small reports, whose size is checked."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.session import bounded


def json_lines(df: DataFrame, path: str, *, append: bool = False) -> None:
    df.write.mode("append" if append else "errorifexists").option("ignoreNullFields", "false").json(path)


def unfinished(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items that a run interrupted before has not done."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def delimited(df: DataFrame, path: str, *, sep: str = ",") -> None:
    """Delimited text with a header; arrays of text become values joined by semicolons."""
    cols = [F.concat_ws(";", c).alias(c) if t == "array<string>" else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.options(header=True, sep=sep, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def training_lines(articles: DataFrame, labels: DataFrame, path: str, *, key: str = "pmid") -> None:
    """Text of every article, with its label if it has one, as JSON lines."""
    text = F.trim(F.concat_ws("\n\n", F.nullif(F.trim("title"), F.lit("")), F.nullif(F.trim("abstract"), F.lit(""))))
    rows = articles.select(key, text.alias("text")).where("text <> ''").join(labels, key, "left")
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(path)


def payload(df: DataFrame, path: str, name: str = "items", *, most: int = 100_000, **about: object) -> None:
    """One JSON document of at most ``most`` rows under ``name``, with what else is to be said about them beside it. More rows are an error; they belong into JSON lines."""
    items = [json.loads(r[0]) for r in bounded(df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})), most, "rows of a document")]
    text = json.dumps({**about, name: items}, ensure_ascii=False, default=str)
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def pmid_list(df: DataFrame, path: str, *, key: str = "pmid", most: int = 1_000_000) -> None:
    """Distinct ids in order, as a JSON document if the path ends in .json, else one a line."""
    ids = df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key)
    if path.endswith(".json"):
        text = json.dumps([r[0] for r in bounded(ids, most, "ids of a document")])
        df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    else:
        ids.select(F.col(key).cast("string")).write.text(path)


def node_link(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The node-link form as JSON lines: ``nodes`` with id and attributes, ``links`` with source and target."""
    n = nodes.withColumnRenamed("node_id", "id")
    e = edges.withColumnsRenamed({"src": "source", "dst": "target"})
    for df, part in ((n, "nodes"), (e, "links")):
        df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(f"{path}/{part}")


def graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as parquet."""
    nodes.write.parquet(f"{path}/nodes")
    edges.write.parquet(f"{path}/edges")


def markdown(df: DataFrame, *, order: Sequence[str] = (), most: int = 500) -> str:
    """A table of at most ``most`` rows as Markdown; fractions with four places, nulls as a dash."""
    rows = bounded(df.orderBy(*order) if order else df, most, "report rows")
    show = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    head = [f"| {' | '.join(df.columns)} |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return "\n".join(head + [f"| {' | '.join(show(v) for v in r)} |" for r in rows]) + "\n"
