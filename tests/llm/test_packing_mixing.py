"""Containers and mixes: every token placed once, constraints kept, shares reached."""

import random

import pytest

from claimloom.llm import mixing, packing
from claimloom.llm.tokens import encoding, ranks_of, sized

DOC = "doc_id bigint, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    random.seed(2)
    rows = []
    for i in range(1, 400):
        src = random.choice(["a", "a", "a", "b", "c", "extraction_dump", None])
        rows.append((i, " ".join(random.choices(["kefir", "milk", "was", "given", "to", "adults"], k=random.choice([0, 3, 20, 60, 200]))), src))
    rows += [(i, "The very same text. " * 5, "a") for i in range(500, 560)] + [(900, None, "b"), (901, "", "b"), (3, "again", "a"), (None, "x", "a"), (902, "long " * 3000, "b")]
    return spark.createDataFrame(rows, DOC)


def test_sizes_are_the_tokenizers(docs):
    enc = encoding(ranks_of())
    for r in sized(docs, with_key=True).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert r["n_tokens"] >= 0
    got = {r["doc_id"]: r["n_tokens"] for r in sized(docs.where("doc_id = 902")).collect()}
    assert got == {902: len(enc.encode_ordinary("long " * 3000))}


def test_packing(spark, docs):
    specs = spark.createDataFrame([(1, 64), (2, 512), (3, 0)], "spec_id int, capacity_tokens int")
    places = packing.packed(docs, specs, apart=("extraction_dump",), shard_tokens=20_000).collect()
    size, source, key = {}, {}, {}
    for r in sized(docs, with_key=True).collect():
        if r["n_tokens"] >= size.get(r["doc_id"], -1):
            size[r["doc_id"]], source[r["doc_id"]], key[r["doc_id"]] = r["n_tokens"], r["source"], r["key"]
    for spec, cap in ((1, 64), (2, 512)):
        mine = [p for p in places if p["spec_id"] == spec]
        pieces, bins = {}, {}
        for p in mine:
            pieces.setdefault(p["doc_id"], []).append((p["token_start"], p["n_tokens"]))
            bins.setdefault(p["container_id"], []).append(p)
        assert set(pieces) == set(size)
        for d, ps in pieces.items():
            ps.sort()
            assert sum(n for _, n in ps) == size[d] and all(a + n == b for (a, n), (b, _) in zip(ps, ps[1:], strict=False))
            assert len(ps) == max(1, -(-size[d] // cap))  # cut only beyond the capacity
        for content in bins.values():
            content.sort(key=lambda p: p["slot"])
            assert sum(p["n_tokens"] for p in content) <= cap and [p["slot"] for p in content] == list(range(len(content)))
            at = 0
            for p in content:
                assert p["offset"] == at
                at += p["n_tokens"]
            rest = [p["doc_id"] for p in content if p["n_tokens"] < cap]
            keys = [key[d] for d in rest if key[d] is not None]
            assert len(keys) == len(set(keys))
            held = {source[d] for d in rest}
            assert "extraction_dump" not in held or held == {"extraction_dump"}
    fill = {r["spec_id"]: r for r in packing.fill(packing.packed(docs, specs), specs).collect()}
    assert fill[1]["used_share"] > 0.8 and fill[2]["fullest"] <= 512
    assert packing.packed(docs.limit(0), specs).count() == 0 and packing.packed(docs, specs.limit(0)).count() == 0


def test_the_tightest_container_is_taken():
    c = packing.Containers(10)
    for size in (4, 7, 6):
        c.open(size, 1, 0)
    assert c.place(3, 1, 1, 0, 0) == [1]
    assert c.place(4, 1, 2, 0, 1) == [3]  # a foreign source opens another one
    assert c.place(4, 2, 1, 8, 0) == [2, 0]  # equal items of one cluster go apart, tightest first
    assert c.place(1, 1, 1, 8, 0) == [3] or c.residual[3] >= 0


def test_mixing(spark, docs):
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.2, 2), ("c", 0.3, 4), ("none", 0.2, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    rows = mixing.mixed(docs, t, slice_rows=25).collect()
    assert [r["finish"] for r in rows] == sorted(r["finish"] for r in rows)
    uses = {}
    for r in rows:
        uses.setdefault(r["doc_id"], []).append(r["use"])
    cap = {"a": 1, "b": 2, "c": 4}
    by_doc = {r["doc_id"]: r["source"] for r in rows}
    assert all(sorted(u) == list(range(len(u))) and len(u) <= cap[by_doc[d]] for d, u in uses.items())
    total = sum(r["n_tokens"] for r in rows)
    most = max(r["n_tokens"] for r in rows)
    for s, w in (("a", 0.5), ("b", 0.2), ("c", 0.3)):
        got = sum(r["n_tokens"] for r in rows if r["source"] == s)
        assert abs(got - w * total) <= 2 * most
    again = {(r["doc_id"], r["use"]) for r in mixing.mixed(docs.repartition(7), t, slice_rows=10**6).collect()}
    assert again == {(r["doc_id"], r["use"]) for r in rows}
    report = {r["source"]: r for r in mixing.shares(docs, t).collect()}
    assert report["none"]["n_tokens"] == 0 and report["c"]["most_uses"] <= 4
    small = mixing.mixed(docs, t, budget=500).collect()
    assert 0 < sum(r["n_tokens"] for r in small) <= 500
    assert mixing.mixed(docs.limit(0), t).count() == 0 and mixing.mixed(docs, t.limit(0)).count() == 0


def test_a_given_budget_is_kept(spark, docs):
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.2, 2), ("c", 0.3, 4)], "source string, target_share double, max_repeats int")
    free = {r["source"]: r for r in mixing.shares(docs, t).collect()}
    most = sum(r["n_tokens"] for r in free.values())
    assert all(r["selected_part"] == round(most / sum(x["tokens_held"] for x in free.values()), 6) for r in free.values())
    budget = 2 * most
    got = {r["source"]: r for r in mixing.shares(docs, t, budget=budget).collect()}
    longest = max(r["n_tokens"] for r in mixing.mixed(docs, t, budget=budget).collect())
    for s, r in got.items():
        want = min(budget * r["target_share"], r["tokens_held"] * r["max_repeats"])
        assert want - longest <= r["n_tokens"] <= want + 1e-6, s
    assert any(r["n_tokens"] == r["tokens_held"] * r["max_repeats"] for r in got.values()) and sum(r["n_tokens"] for r in got.values()) > most
