"""Problem 2: the k most similar vectors of every vector, by cosine.

Method: an inverted multi-index. The two halves of the unit vectors are quantised separately by centroids fitted on a bounded
sample; every vector is filed under its pair of centroids. Each vector then visits pairs in the order of their summed distance,
taken from a heap, until the pairs visited hold ``candidates`` entries (all entries of a visited pair count, none are cut), and
what is found is reranked by exact cosine.

For Spark, the pairs of first centroids that lie together form one shard. An entry is sent to its shard once, a query once to each
shard it visits, both as 16-bit integers per coordinate (renormalised after arrival; the error of a cosine is about 1e-6), so a
vector moves a few times its own size however large the collection is. A shard is a grid of parts: its entries are split by their
id where they are more than ``shard_rows``, its queries where, by the visits of a sample, more than ``shard_rows`` are to be
expected; every part of the queries meets every part of the entries once, and no part grows with the collection. Copies are vectors of one direction, whatever their norm: those that are the
same as 16-bit integers. Of more than k + 1 copies only the k + 1 smallest ids are filed; the others get what the smallest of them
finds and these k + 1 themselves, which loses nothing, as no vector's k nearest hold a copy beyond them.

The number of centroids grows with the square root of the collection, to ``most_centroids`` a half, whose pairs' counts are what is
broadcast (4 bytes each: 64 MB at most). From about 400 million vectors on cells grow instead, and with them the entries that each
query visits, so that the number of cells does not fall.

Vectors that are null, of another length, all zero, or hold a null or something that is no finite number take no part. Equally
similar vectors are taken by smaller id. Rows delivered twice under one id count once. An empty or one-row table yields no pair;
tables of up to ``candidates`` rows are searched exhaustively.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.session import bounded, written

DIM = 64
#: Vectors the centroids are fitted on: at least so many, more where so many a centroid are more.
SAMPLE = 20_000
SAMPLE_A_CENTROID = 20
MOST_CENTROIDS = 4096
#: Vectors up to which ``candidates`` is enough; beyond, a query visits more, with the fourth root of the collection's size.
MEASURED = 120_000
#: Sampled vectors whose visits tell how many queries a shard is to expect.
VISITS = 2_000


def usable(df: DataFrame, id_col: str, vec: str, dim: int = DIM) -> DataFrame:
    """``id``, ``v`` of the vectors of ``dim`` finite numbers that are not all zero, one row an id."""
    v = F.col(vec)
    fine = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("bigint").alias("id"), v.cast("array<float>").alias("v")).where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    x = col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype("f8")
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _pack(x: np.ndarray) -> list[bytes]:
    """Unit vectors as 16-bit integers of the largest coordinate's scale."""
    q = np.rint(x * (32767 / np.abs(x).max(1, keepdims=True))).astype("<i2")
    return [r.tobytes() for r in q]


def _unpack(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(col.to_pylist()), "<i2").reshape(-1, dim).astype("f8")
    return x / np.sqrt((x * x).sum(1, keepdims=True)) if len(x) else x


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm from distinct random points; empty centroids move to the points that fit worst."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.empty(len(x), int)
        far = np.empty(len(x))
        for s in range(0, len(x), 4096):
            d = (c * c).sum(1)[None] - 2 * x[s : s + 4096] @ c.T
            near[s : s + 4096] = d.argmin(1)
            far[s : s + 4096] = d.min(1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            c[empty] = x[np.argsort(-far)[: len(empty)]]
    return c


def visit(d1: np.ndarray, d2: np.ndarray, held: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """Centroid pairs by summed distance, from a heap, until they hold ``wanted`` entries. Empty pairs are passed over."""
    o1, o2 = d1.argsort(kind="stable"), d2.argsort(kind="stable")
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    o1l, o2l = o1.tolist(), o2.tolist()
    heap = [(s1[0] + s2[0], 0, 0)]
    out, got, n1, n2 = [], 0, len(s1), len(s2)
    while heap and got < wanted:
        _, i, j = heapq.heappop(heap)
        n = held[o1l[i], o2l[j]]
        if n:
            out.append((o1l[i], o2l[j]))
            got += int(n)
        if j + 1 < n2:
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if j == 0 and i + 1 < n1:
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
    return out


def _top(ids: np.ndarray, q: np.ndarray, e: np.ndarray, qid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the k most similar of the entries, itself left out: positions of queries, ids, cosines."""
    out = []
    step = max(1, min(2048, 8_000_000 // max(len(ids), 1)))
    for s in range(0, len(q), step):
        a = q[s : s + step]
        sim = a.astype("f4") @ e.astype("f4").T
        sim[qid[s : s + step][:, None] == ids[None]] = -9
        take = min(len(ids), k + 4)
        best = np.argpartition(-sim, take - 1, axis=1)[:, :take] if take < len(ids) else np.broadcast_to(np.arange(len(ids)), sim.shape)
        rough = np.take_along_axis(sim, best, 1)
        if take < len(ids):  # entries as similar as the last one taken, such as copies, must all be compared
            last = rough.min(1)
            more = (sim >= (last - 2e-6)[:, None]).sum(1) > take
            for r in np.flatnonzero(more):
                full = np.flatnonzero(sim[r] >= last[r] - 2e-6)
                exact = (e[full] * a[r]).sum(1)
                o = np.lexsort((ids[full], -np.round(exact, 9)))[:take]
                best = best.copy() if not best.flags.writeable else best
                best[r] = np.resize(full[o], take)
            rough = np.take_along_axis(sim, best, 1)
        rows = np.repeat(np.arange(len(a)), best.shape[1])
        cols = best.ravel()
        live = rough.ravel() > -5
        rows, cols = rows[live], cols[live]
        exact = np.round((e[cols] * a[rows]).sum(1), 9)
        o = np.lexsort((ids[cols], -exact, rows))
        rows, cols, exact = rows[o], cols[o], exact[o]
        fresh = np.r_[True, (rows[1:] != rows[:-1]) | (ids[cols][1:] != ids[cols][:-1])] if len(rows) else np.zeros(0, bool)
        rows, cols, exact = rows[fresh], cols[fresh], exact[fresh]
        first = np.searchsorted(rows, rows, "left")
        keep = np.arange(len(rows)) - first < k
        out.append((rows[keep] + s, ids[cols[keep]], exact[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, "i8"), np.zeros(0))


def most_similar(
    df: DataFrame, id_col: str = "vec_id", vec: str = "embedding", *, k: int = 5, dim: int = DIM, candidates: int = 2500, sample: int = SAMPLE, shard_rows: int = 100_000, cell_rows: int = 24, most_centroids: int = MOST_CENTROIDS
) -> DataFrame:
    """``id``, ``other``, ``cosine``: for every usable vector the k most similar others."""
    data = usable(df, id_col, vec, dim)
    n = data.count()
    centroids, some = _centroids(data, n, dim, sample, cell_rows, most_centroids)
    if centroids is None:
        return data.select("id", F.col("id").alias("other"), F.lit(0.0).alias("cosine")).where("false")
    filed, kept, spare = _thin_copies(written(_file(data, centroids, dim), "filed-vectors"), k)
    k1, k2 = (len(c) for c in centroids)
    held = np.zeros((k1, k2), "i4")
    counts = filed.groupBy("c1", "c2").agg(F.count("*").cast("int").alias("n")).toArrow()  # a row a pair of centroids, at most ``most_centroids`` squared
    held[counts.column("c1").to_numpy(), counts.column("c2").to_numpy()] = counts.column("n").to_numpy()
    total = int(held.sum(dtype="i8"))
    wanted = candidates * max(1.0, total / MEASURED) ** 0.25
    wanted = round(max(wanted, wanted * total / (k1 * k2) / cell_rows) if k1 >= most_centroids else wanted)
    groups = _groups(centroids[0], max(k1 / 6, total / 50_000))
    parts = np.maximum(1, -(-np.bincount(groups, held.sum(1, dtype="i8")).astype("i8") // shard_rows)).astype("i4")
    asked = np.maximum(1, np.ceil(_expected(some, centroids, held, groups, wanted) * total / shard_rows)).astype("i4")
    sent = _send(filed, centroids, held, groups, parts, asked, wanted, dim)
    hits = sent.groupBy("shard", "part").applyInArrow(lambda t: _search(t, dim, k), "id bigint, other bigint, cosine double")
    best = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "other")
    top = hits.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")
    if kept is None:
        return top
    top = written(top, "nearest-vectors")
    return top.unionByName(_answers(top, kept, spare, k))


def _centroids(data: DataFrame, n: int, dim: int, sample: int, cell_rows: int, most: int) -> tuple[tuple[np.ndarray, np.ndarray] | None, np.ndarray]:
    """Centroids of both halves, from a sample of vectors chosen by a hash of their id, whose size is bounded by ``sample`` and ``most``; and some of the sample."""
    k = max(1, min(most, round(math.sqrt(n / cell_rows))))
    sample = max(sample, SAMPLE_A_CENTROID * k)
    share = min(1.0, 0.9 * sample / max(n, 1))
    some = data if share == 1.0 else data.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = bounded(some, sample + 2_000, "sample of vectors") if n else []
    if not rows:
        return None, np.zeros((0, dim))
    rows.sort(key=lambda r: r["id"])
    x = np.array([r["v"] for r in rows], "f8")
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    k = min(k, len(x))
    return (kmeans(x[:, : dim // 2], k), kmeans(x[:, dim // 2 :], k)), x[:: -(-len(x) // VISITS)]


def _expected(x: np.ndarray, centroids: tuple[np.ndarray, np.ndarray], held: np.ndarray, groups: np.ndarray, wanted: int) -> np.ndarray:
    """The share of all queries that visits each shard, from some vectors."""
    a, b = centroids
    half = a.shape[1]
    d1, d2 = (a * a).sum(1)[None] - 2 * x[:, :half] @ a.T, (b * b).sum(1)[None] - 2 * x[:, half:] @ b.T
    out = np.zeros(groups.max() + 1)
    for r in range(len(x)):
        out[np.unique([groups[i] for i, _ in visit(d1[r], d2[r], held, wanted)])] += 1
    return out / max(len(x), 1)


def _groups(c: np.ndarray, wanted: float) -> np.ndarray:
    """The group of each centroid: so many groups of centroids that lie together, or every one on its own."""
    if wanted >= len(c):
        return np.arange(len(c))
    g = kmeans(c, max(1, round(wanted)))
    return ((g * g).sum(1)[None] - 2 * c @ g.T).argmin(1)


def _thin_copies(filed: DataFrame, k: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Leave out the copies beyond the k + 1 smallest ids of a packed vector. Besides: the ``key``, ``id`` and rank ``r`` of those kept, the ``id`` and ``key`` of those left out."""
    key = F.struct(F.xxhash64("v").alias("a"), F.xxhash64("v", F.lit(1)).alias("b"))
    keyed = filed.select("id", key.alias("key"))
    hot = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > k + 1).select("key"), "copied-vectors")
    if hot.isEmpty():
        return filed, None, None
    members = keyed.join(hot, "key", "left_semi").distinct()
    salted = Window.partitionBy("key", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    some = members.withColumn("_r", F.row_number().over(salted)).where(F.col("_r") <= k + 1).drop("_r")
    kept = some.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("r") <= k + 1)
    kept = written(kept, "kept-copies")
    spare = written(members.join(kept.select("id"), "id", "left_anti"), "spare-copies")
    return written(filed.join(spare.select("id"), "id", "left_anti"), "thinned-vectors"), kept, spare


def _answers(top: DataFrame, kept: DataFrame, spare: DataFrame, k: int) -> DataFrame:
    """The neighbours of the copies left out: the nearest among the kept ones of their key and the neighbours of its smallest id."""
    first = kept.where("r = 1").select("key", "id").join(top, "id").select("key", "other", "cosine")
    near = first.unionByName(kept.select("key", F.col("id").alias("other"), F.lit(1.0).alias("cosine"))).groupBy("key", "other").agg(F.max("cosine").alias("cosine"))
    best = Window.partitionBy("key").orderBy(F.col("cosine").desc(), "other")
    near = near.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
    lists = near.groupBy("key").agg(F.collect_list(F.struct("other", "cosine")).alias("l"))  # k at most
    return spare.join(lists, "key").select("id", F.explode("l").alias("x")).select("id", "x.other", "x.cosine")


def _file(data: DataFrame, centroids: tuple[np.ndarray, np.ndarray], dim: int) -> DataFrame:
    shared = data.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = shared.value
        for t in batches:
            if not t.num_rows:
                continue
            x = _matrix(t.column("v"), dim)
            c1 = ((a * a).sum(1)[None] - 2 * x[:, : dim // 2] @ a.T).argmin(1)
            c2 = ((b * b).sum(1)[None] - 2 * x[:, dim // 2 :] @ b.T).argmin(1)
            yield pa.RecordBatch.from_arrays([t.column("id"), pa.array(_pack(x), pa.binary()), pa.array(c1, pa.int32()), pa.array(c2, pa.int32())], names=["id", "v", "c1", "c2"])

    return data.mapInArrow(run, "id bigint, v binary, c1 int, c2 int")


def _send(filed: DataFrame, centroids: tuple[np.ndarray, np.ndarray], held: np.ndarray, groups: np.ndarray, parts: np.ndarray, asked: np.ndarray, candidates: int, dim: int) -> DataFrame:
    """Each entry to its shard and each query to the shards it visits; in a shard, an entry to its part of the entries with every part of the queries, and the other way round. ``own`` is the number of the entry's pair, ``cells`` those of the pairs the query visits; where both meet one row carries both."""
    shared = filed.sparkSession.sparkContext.broadcast((centroids, held, groups.tolist(), parts.tolist(), asked.tolist()))
    schema = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("id", pa.int64()), ("v", pa.binary()), ("own", pa.int32()), ("cells", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (a, b), n, group, split, ways = shared.value
        na, nb, k2 = (a * a).sum(1), (b * b).sum(1), len(b)
        for t in batches:
            if not t.num_rows:
                continue
            ids, raw = t.column("id").to_pylist(), t.column("v").to_pylist()
            own1, own2 = t.column("c1").to_pylist(), t.column("c2").to_pylist()
            x = _unpack(t.column("v"), dim)
            d1, d2 = na[None] - 2 * x[:, : dim // 2] @ a.T, nb[None] - 2 * x[:, dim // 2 :] @ b.T
            out: list[list] = [[] for _ in schema]
            for r in range(t.num_rows):
                at = group[own1[r]]
                by: dict[int, list[int]] = {at: []}
                for i, j in visit(d1[r], d2[r], n, candidates):
                    by.setdefault(group[i], []).append(i * k2 + j)
                for shard, cells in by.items():
                    packed = np.array(cells, "<i4").tobytes()
                    home, way = ids[r] % split[shard] if shard == at else -1, ids[r] // split[shard] % ways[shard]
                    for p in range(split[shard]):
                        for w in range(ways[shard]):
                            asks = cells and w == way
                            if asks or p == home:
                                for col, val in zip(out, (shard, p * ways[shard] + w, ids[r], raw[r], own1[r] * k2 + own2[r] if p == home else -1, packed if asks else b""), strict=True):
                                    col.append(val)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return filed.mapInArrow(run, "shard int, part int, id bigint, v binary, own int, cells binary")


def _search(t: pa.Table, dim: int, k: int) -> pa.Table:
    """All queries of a shard against the entries of the pairs each of them visits."""
    order = np.lexsort((-t.column("own").to_numpy(), t.column("id").to_numpy()))
    ids = t.column("id").to_numpy()[order]
    t = t.take(order[np.r_[True, ids[1:] != ids[:-1]]])  # rows delivered twice
    ids, own = t.column("id").to_numpy(), t.column("own").to_numpy()
    x = _unpack(t.column("v"), dim)
    is_entry = own >= 0
    e_ids, e_own, e = ids[is_entry], own[is_entry], x[is_entry]
    o = np.lexsort((e_ids, e_own))
    e_ids, e_own, e = e_ids[o], e_own[o], e[o]
    cells = t.column("cells").to_pylist()
    many = np.array([len(c) // 4 for c in cells])
    q = np.repeat(np.arange(len(ids)), many)
    c = np.frombuffer(b"".join(cells), "<i4").astype(int)
    o = np.argsort(c, kind="stable")
    q, c = q[o], c[o]
    found = []
    for cell in np.unique(c):
        lo, hi = np.searchsorted(e_own, [cell, cell + 1])
        if lo < hi:
            s, f = np.searchsorted(c, [cell, cell + 1])
            mine = q[s:f]
            rows, other, cos = _top(e_ids[lo:hi], x[mine], e[lo:hi], ids[mine], k)
            found.append((ids[mine][rows], other, cos))
    if not found:
        return pa.table({"id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
    a, b, s = (np.concatenate(y) for y in zip(*found, strict=True))
    o = np.lexsort((b, -s, a))
    a, b, s = a[o], b[o], s[o]
    keep = np.arange(len(a)) - np.searchsorted(a, a, "left") < k
    return pa.table({"id": a[keep], "other": b[keep], "cosine": s[keep]})


def found(df: DataFrame, **how: int) -> DataFrame:
    """Each pair once in which one vector is among the most similar of the other."""
    top = most_similar(df, **how)
    return top.select(F.least("id", "other").alias("vec_id_a"), F.greatest("id", "other").alias("vec_id_b")).distinct()


def recall(df: DataFrame, *, queries: int = 2_000, k: int = 5, dim: int = DIM, **how: int) -> DataFrame:
    """Recall of the index against brute force for all vectors whose id is divisible by 50, about ``queries`` of them at a time: one row."""
    data = usable(df, "vec_id", "embedding", dim)
    asked = written(data.where(F.col("id") % 50 == 0).dropDuplicates(["id"]), "recall-queries")
    blocks = max(1, -(-asked.count() // queries))
    best = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "other")
    true = None
    for at in range(blocks):
        rows = bounded(asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == at), 2 * queries + 1_000, "queries of the recall measure")
        near = data.mapInArrow(_compare(df, rows, dim, k), "id bigint, other bigint, cosine double").distinct()
        near = written(near.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).select("id", "other"), "true-neighbours")
        true = near if true is None else true.unionByName(near)
    got = most_similar(df, k=k, dim=dim, **how).select("id", "other", F.lit(1).alias("hit"))
    both = true.join(got, ["id", "other"], "left")
    return both.agg(F.countDistinct("id").alias("n_queries"), F.count("*").alias("n_true"), F.sum(F.coalesce("hit", F.lit(0))).alias("n_found")).withColumn("recall", F.round(F.try_divide("n_found", "n_true"), 4))


def _compare(df: DataFrame, rows: list[Row], dim: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each batch's nearest to the given queries."""
    qid = np.array([r["id"] for r in rows], "i8")
    q = np.array([r["v"] for r in rows], "f8").reshape(-1, dim)
    q = q / np.sqrt((q * q).sum(1, keepdims=True)) if len(q) else q
    shared = df.sparkSession.sparkContext.broadcast((qid, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        for t in batches:
            if t.num_rows and len(ids):
                r, other, cos = _top(t.column("id").to_numpy(), x, _matrix(t.column("v"), dim), ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(other), pa.array(cos)], names=["id", "other", "cosine"])

    return run
