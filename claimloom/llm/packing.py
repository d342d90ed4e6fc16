"""Problem 7: texts of varying length in containers of fixed capacity, with little space unused.

Method: conflict-constrained best fit; texts of clusters come first, then all others, each from the largest to the smallest. Open containers are ordered by what is left in them; a bitmap of the
residuals in use gives the successor of an item's size, and the search goes on from successor to successor until the tightest
container is found whose bitmaps of sources and of duplicate clusters allow the item. Texts with the same letters and digits form
a cluster and never share a container; sources named in ``apart`` (none by default) only share one with texts of the same source.

Texts are spread over shards by a hash of their id, as many as the corpus's tokens and rows demand, so a shard has a bounded size
and every shard is packed on its own; at most its last few containers are not full. Equal items of one cluster, such as the
copies of a text, are placed in one sweep over the containers, so a text copied a million times costs no more than others.

A text longer than the capacity is cut into full containers and one rest; no other text is cut. Texts without tokens, null and
empty ones included, take a place of size 0. Rows delivered twice under one id are packed once, as the longest of them. Ties go
to the container opened first. An empty table of texts or of capacities yields no row; capacities below 1 are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.tokens import TOKENIZER, sized
from claimloom.session import bounded, written

PLACES = "spec_id int, container_id bigint, slot int, offset bigint, doc_id bigint, piece int, token_start bigint, n_tokens bigint"


class Containers:
    """Containers of one capacity, ordered by residual."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.residual: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.at: dict[int, list[int]] = {}  # residual -> containers, oldest first
        self.used = 0  # bitmap of the residuals in use

    def open(self, size: int, source: int, cluster: int) -> int:
        i = len(self.residual)
        self.residual.append(self.capacity - size)
        self.sources.append(source)
        self.clusters.append(cluster)
        self._file(i)
        return i

    def _file(self, i: int) -> None:
        r = self.residual[i]
        if r in self.at:
            self.at[r].append(i)
        else:
            self.at[r] = [i]
            self.used |= 1 << r

    def successors(self, size: int) -> Iterator[int]:
        """Containers with room for a size, tightest first."""
        rest = self.used >> size
        r = size
        while rest:
            low = (rest & -rest).bit_length() - 1
            r += low
            yield from self.at[r]
            rest >>= low + 1
            r += 1

    def place(self, size: int, n: int, source: int, cluster: int, foreign: int) -> list[int]:
        """Containers for n items of one size, source and cluster. ``foreign``: the sources they must not meet."""
        out: list[int] = []
        if cluster or n == 1:
            for i in self.successors(size):
                if not (self.sources[i] & foreign or self.clusters[i] & cluster):
                    out.append(i)
                    if len(out) == n:
                        break
            for i in out:
                self._add(i, size, source, cluster)
            out += [self.open(size, source, cluster) for _ in range(n - len(out))]
            return out
        for _ in range(n):
            out += self.place(size, 1, source, 0, foreign)
        return out

    def _add(self, i: int, size: int, source: int, cluster: int) -> None:
        if size:
            r = self.residual[i]
            same = self.at[r]
            same.remove(i)
            if not same:
                del self.at[r]
                self.used &= ~(1 << r)
            self.residual[i] = r - size
            self._file(i)
        self.sources[i] |= source
        self.clusters[i] |= cluster


def pack(ids: Sequence[int], sizes: Sequence[int], sources: Sequence[str | None], keys: Sequence[bytes | None], capacity: int, apart: Sequence[str] = ()) -> list[tuple[int, int, int, int, int, int]]:
    """Places of a shard's texts: container, slot, offset, index of the text, first token, tokens."""
    index = {s: i for i, s in enumerate(sorted({s or "" for s in sources}))}
    alone = sum(1 << index[s] for s in apart if s in index)
    every = (1 << len(index)) - 1
    copies: dict[bytes, int] = {}
    for k in keys:
        if k is not None:
            copies[k] = copies.get(k, 0) + 1
    clusters = {k: 1 << i for i, k in enumerate(sorted(k for k, n in copies.items() if n > 1))}
    open_ = Containers(capacity)
    filled: list[list[tuple[int, int, int]]] = []
    items: list[tuple[int, int, bytes, int, int, int]] = []
    for i, (d, n, s, k) in enumerate(zip(ids, sizes, sources, keys, strict=True)):
        whole, rest = divmod(n, capacity)
        for p in range(whole):
            open_.open(capacity, 1 << index[s or ""], 0)
            filled.append([(i, p * capacity, capacity)])
        if rest or not n:
            items.append((-rest, index[s or ""], k if k in clusters else b"", d, i, whole * capacity))
    items.sort(key=lambda x: (not x[2], x))  # those with conflicts first: small ones would find too few containers at the end
    at = 0
    while at < len(items):
        size, s, k = -items[at][0], items[at][1], items[at][2]
        end = at + 1
        while end < len(items) and items[end][:3] == items[at][:3]:
            end += 1
        mine = 1 << s
        foreign = every & ~mine if mine & alone else alone & ~mine
        for (_, _, _, _, i, first), c in zip(items[at:end], open_.place(size, end - at, mine, clusters.get(k, 0), foreign), strict=True):
            if c == len(filled):
                filled.append([])
            filled[c].append((i, first, size))
        at = end
    out = []
    for c, content in enumerate(filled):
        offset = 0
        for slot, (i, first, n) in enumerate(content):
            out.append((c, slot, offset, i, first, n))
            offset += n
    return out


def packed(docs: DataFrame, specs: DataFrame, *, apart: Sequence[str] = (), tokenizer: str = TOKENIZER, shard_tokens: int = 4_000_000, shard_rows: int = 20_000) -> DataFrame:
    """The place of every text, or piece of one, for every capacity."""
    capacities = sorted({(r["spec_id"], r["capacity_tokens"]) for r in bounded(specs.select("spec_id", "capacity_tokens").where("capacity_tokens >= 1 and spec_id is not null"), 1_000, "container specs")})
    texts = written(sized(docs, tokenizer=tokenizer, with_key=True), "sized-texts")
    total = texts.agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).first()
    shards = max(1, -(-(total["t"] or 0) // shard_tokens), -(-total["n"] // shard_rows))
    sharded = texts.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))

    def run(t: pa.Table) -> pa.Table:
        best: dict[int, int] = {}
        ids, sizes = t.column("doc_id").to_pylist(), t.column("n_tokens").to_pylist()
        for i, (d, n) in enumerate(zip(ids, sizes, strict=True)):
            if d not in best or n > sizes[best[d]]:
                best[d] = i
        pick = sorted(best.values(), key=lambda i: ids[i])
        ids, sizes = [ids[i] for i in pick], [sizes[i] for i in pick]
        sources, keys = t.column("source").take(pick).to_pylist(), t.column("key").take(pick).to_pylist()
        shard = t.column("shard")[0].as_py()
        tables = []
        for spec, capacity in capacities:
            got = np.array(pack(ids, sizes, sources, keys, capacity, apart), "i8").reshape(-1, 6)
            doc = np.array(ids, "i8")[got[:, 3]]
            cols = [np.full(len(got), spec, "i4"), (shard << 32) + got[:, 0], got[:, 1].astype("i4"), got[:, 2], doc, (got[:, 4] // capacity).astype("i4"), got[:, 4], got[:, 5]]
            tables.append(pa.table(dict(zip([c.split()[0] for c in PLACES.split(", ")], cols, strict=True))))
        return pa.concat_tables(tables) if tables else pa.table({c.split()[0]: pa.array([], pa.int32() if c.endswith("int") and not c.endswith("bigint") else pa.int64()) for c in PLACES.split(", ")})

    return sharded.groupBy("shard").applyInArrow(run, PLACES)


def fill(places: DataFrame, specs: DataFrame) -> DataFrame:
    """For each capacity: containers, tokens, and the share of the space that is used."""
    each = places.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k"))
    total = each.groupBy("spec_id").agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"), F.sum("k").alias("n_places"), F.max("n").alias("fullest"))
    used = F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6)
    return total.join(specs.select("spec_id", "capacity_tokens"), "spec_id").withColumn("used_share", used)
