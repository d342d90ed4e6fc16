"""The index against brute force, ties, copies, hot cells and vectors that take no part."""

import numpy as np
import pytest

from claimloom.llm import neighbours as N

SCHEMA = "vec_id bigint, embedding array<float>"


def brute(rows, k=5):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], "f4").astype("f8")
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    s = np.round(x @ x.T, 9)
    out = set()
    for r in range(len(ids)):
        s[r, r] = -9
        for c in np.lexsort((ids, -s[r]))[:k]:
            if c != r:
                out.add((min(ids[r], ids[c]), max(ids[r], ids[c])))
    return out


def clustered(n, seed=0, spread=0.08):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(2, n // 15), 64))
    return [(int(i), (centres[rng.integers(len(centres))] + rng.normal(size=64) * spread * 5).tolist()) for i in range(1, n + 1)]


@pytest.mark.parametrize("n", [2, 6, 40])
def test_small_tables_are_exact(spark, n):
    rows = clustered(n, n)
    got = {tuple(r) for r in N.found(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_recall(spark):
    rows = clustered(3000, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in N.found(df).collect()}
    want = brute(rows)
    assert len(got & want) / len(want) > 0.95 and len(got & want) / len(got) > 0.95
    r = N.recall(df, queries=500).first()
    assert r["recall"] >= 0.9 and r["n_true"] == 5 * r["n_queries"]


def test_split_shards_give_the_same(spark):
    df = spark.createDataFrame(clustered(600, 5), SCHEMA)
    a = {tuple(r) for r in N.most_similar(df).select("id", "other").collect()}
    b = {tuple(r) for r in N.most_similar(df, shard_rows=40).select("id", "other").collect()}
    assert a == b


def test_copies_and_ties_go_by_id(spark):
    v, w = np.ones(64).tolist(), np.eye(64)[0].tolist()
    rows = [(i, v) for i in range(20, 0, -1)] + [(100, w), (101, w)]
    got = {}
    for r in N.most_similar(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r["id"], []).append((r["other"], r["cosine"]))
    assert sorted(o for o, _ in got[20]) == [1, 2, 3, 4, 5]
    assert sorted(o for o, _ in got[3]) == [1, 2, 4, 5, 6]
    assert max(got[100], key=lambda x: x[1]) == (101, 1.0)
    assert all(len(x) == 5 for x in got.values())


def test_unusable_vectors_take_no_part(spark):
    fine = clustered(8, 1)
    bad = [(90, None), (91, []), (92, [1.0] * 63), (93, [0.0] * 64), (94, [float("nan")] * 64), (95, [float("inf")] + [1.0] * 63), (96, [None] + [1.0] * 63), (None, [1.0] * 64)]
    got = {tuple(r) for r in N.found(spark.createDataFrame(fine + bad + fine, SCHEMA)).collect()}
    assert got == brute(fine)
    assert N.found(spark.createDataFrame(bad[:3], SCHEMA)).count() == 0
    assert N.found(spark.createDataFrame([], SCHEMA)).count() == 0
    assert N.recall(spark.createDataFrame([], SCHEMA)).first()["recall"] is None


def test_pairs_are_visited_by_summed_distance():
    rng = np.random.default_rng(4)
    d1, d2 = rng.random(9), rng.random(7)
    held = rng.integers(0, 4, (9, 7))
    got = N.visit(d1, d2, held, 10**9)
    sums = [d1[i] + d2[j] for i, j in got]
    assert sums == sorted(sums) and len(got) == (held > 0).sum() == len(set(got))
    assert sum(held[i, j] for i, j in N.visit(d1, d2, held, 12)) >= 12


def test_copies_of_any_norm_are_neighbours(spark):
    v = np.random.default_rng(2).normal(size=64)
    rows = [(i, v.tolist()) for i in range(100, 120)] + [(1, (v * 2).tolist()), (2, (v * 3.3).tolist()), (3, (v / 7).tolist()), (150, (v * 0.1).tolist())] + [(i + 300, x) for i, x in clustered(30, 6)]
    got = {}
    for r in N.most_similar(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r["id"], set()).add(r["other"])
    assert got[119] == got[150] == {1, 2, 3, 100, 101} and got[1] == {2, 3, 100, 101, 102}
    assert {tuple(r) for r in N.found(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)


def test_recall_asks_all_ids_divisible_by_50_in_blocks(spark):
    df = spark.createDataFrame([(i * 10, v) for i, v in clustered(400, 8)], SCHEMA)
    for queries in (2000, 20):
        r = N.recall(df, queries=queries).first()
        assert (r["n_queries"], r["n_true"], r["recall"]) == (80, 400, 1.0)


def test_hot_shards_are_split_by_entries_and_queries(spark):
    """A third of all vectors are near copies of one, so their cell and its queries are hot."""
    rng = np.random.default_rng(9)
    hot = rng.normal(size=64)
    rows = clustered(400, 10) + [(i + 1000, (hot + rng.normal(size=64) * 0.01).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    a = {tuple(r) for r in N.most_similar(df, candidates=150).select("id", "other").collect()}
    b = {tuple(r) for r in N.most_similar(df, candidates=150, shard_rows=30).select("id", "other").collect()}
    assert a == b and len(a) == 600 * 5


def test_cells_grow_where_centroids_are_bounded(spark):
    rows = clustered(3000, 12)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in N.found(df, most_centroids=3, candidates=300).collect()}
    want = brute(rows)
    assert len(got & want) / len(want) > 0.9
