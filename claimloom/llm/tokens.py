"""Sizes of texts in tokens of a public tokenizer, whose file is a parameter; it is read once, on the driver, and goes to the tasks with the session."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Byte-level BPE as ranks, and the pattern that comes with it. Fixed values.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Bytes a rank file may have to be broadcast.
MOST_BYTES = 64 << 20


def ranks_of(path: str = TOKENIZER) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(MOST_BYTES + 1)
    if len(raw) > MOST_BYTES:
        raise ValueError(f"{path}: more than {MOST_BYTES} bytes")
    return raw


def encoding(raw: bytes):
    """The tokenizer of a rank file's content."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def content_key(text: Column) -> Column:
    """16 bytes that texts share if they have the same letters and digits in the same order, regardless of case; null for texts without any."""
    bare = F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")
    return F.when(bare != "", F.unhex(F.md5(F.lower(bare))))


def sized(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER, with_key: bool = False) -> DataFrame:
    """``doc_id``, ``source``, ``n_tokens`` and, if asked for, ``key`` of every row with an id. Null texts have no tokens. Whole texts are encoded; only their numbers of tokens leave the task."""
    cols = [F.col(id_col).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text")]
    rows = docs.select(*cols).where("doc_id is not null")
    if with_key:
        rows = rows.withColumn("key", content_key(F.col("text")))
    keep = ["doc_id", "source", *(["key"] if with_key else [])]

    shared = docs.sparkSession.sparkContext.broadcast(ranks_of(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(shared.value)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    return rows.mapInArrow(run, "doc_id bigint, source string, " + ("key binary, " if with_key else "") + "n_tokens bigint")
