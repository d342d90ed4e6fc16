"""Consensus labels on simulated reviewers, counts against brute force, and odd decisions."""

import numpy as np
import pytest

from claimloom.llm import consensus as C

SCHEMA = "decision_id bigint, audit_id string, reviewer_id string, subject_correct string, direction_correct string, snippet_supports_claim string, decided_at int"


def simulated(n_items=600, seed=0):
    rng = np.random.default_rng(seed)
    even = lambda a: np.eye(3) * a + (1 - np.eye(3)) * (1 - a) / 2
    yes, adverse = np.array([[0.96, 0.02, 0.02], [0.9, 0.08, 0.02], [0.89, 0.02, 0.09]]), np.array([[0.15, 0.7, 0.15], [0.66, 0.2, 0.14], [0.33, 0.4, 0.27]])
    kinds = [even(0.95)] * 5 + [even(0.8)] * 6 + [even(0.5)] * 4 + [yes] * 4 + [adverse] * 3 + [np.ones((3, 3)) / 3] * 3
    truth = {f: rng.choice(3, n_items, p=[0.65, 0.2, 0.15]) for f in C.FIELDS}
    rows, k = [], 0
    for i in range(n_items):
        for w in rng.choice(len(kinds), rng.integers(3, 8), replace=False):
            k += 1
            rows.append((k, f"a{i}", f"r{w:02}", *(C.LABELS[rng.choice(3, p=kinds[w][truth[f][i]])] for f in C.FIELDS), k))
    return rows, truth


def test_better_than_the_majority(spark):
    rows, truth = simulated()
    got = {(r["audit_id"], r["field"]): r["label"] for r in C.found(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 600 * 3
    right = np.mean([got[f"a{i}", f] == C.LABELS[truth[f][i]] for f in C.FIELDS for i in range(600)])
    votes = {}
    for _, a, _, *v, _ in rows:
        for f, x in zip(C.FIELDS, v, strict=True):
            votes.setdefault((a, f), []).append(x)
    majority = np.mean([max(C.LABELS, key=votes[f"a{i}", f].count) == C.LABELS[truth[f][i]] for f in C.FIELDS for i in range(600)])
    assert right > 0.85 and right > majority + 0.04
    rel = {(r["who"], r["field"]): r["reliability"] for r in C.reviewers(spark.createDataFrame(rows, SCHEMA)).collect()}
    mean = lambda ks: np.mean([rel[f"r{k:02}", f] for k in ks for f in C.FIELDS])
    assert mean(range(5)) > mean(range(5, 11)) > mean(range(11, 15)) > mean(range(19, 22))


def moments_by_pairs(rows):
    """The closed form with every pair and triple made, one annotator after the other: labels, and the label shares."""
    ks, votes, cast = range(3), {}, {}
    for _, a, w, *v, _ in rows:
        for f, x in zip(C.FIELDS, v, strict=True):
            votes.setdefault((f, a), {})[w] = x
            cast.setdefault((w, f), [0, 0, 0])[C.LABELS.index(x)] += 1
    rate = {k: np.array(c) / sum(c) for k, c in cast.items()}
    who = sorted({w for w, _ in cast})
    total = {w: sum(sum(cast.get((w, f), [0])) for f in C.FIELDS) for w in who}
    u = {w: np.ones(3) for w in who}
    for _ in range(2):
        m = {f: np.zeros((4, 3)) for f in C.FIELDS}
        one = {(w, f): np.zeros((4, 3)) for w in who for f in C.FIELDS}
        for (f, _), by in votes.items():
            z = {w: np.array([x == y for y in C.LABELS]) - rate[w, f] for w, x in by.items()}
            for i in by:
                for j in by:
                    if j == i:
                        continue
                    one[i, f][0] += z[i] * u[j] * z[j]
                    one[i, f][1] += u[j] ** 2
                    m[f][0] += u[i] * z[i] * u[j] * z[j]
                    m[f][1] += u[i] ** 2 * u[j] ** 2
                    for k in by:
                        if k in (i, j):
                            continue
                        one[i, f][2] += u[j] * z[j] * u[k] * z[k]
                        one[i, f][3] += u[j] ** 2 * u[k] ** 2
                        m[f][2] += u[i] * z[i] * u[j] * z[j] * u[k] * z[k]
                        m[f][3] += (u[i] * u[j] * u[k]) ** 2
        share = {}
        for f in C.FIELDS:
            p = np.array([C.share_by_triples(m[f][0][x] / m[f][1][x], m[f][2][x] / m[f][3][x]) for x in ks])
            share[f] = p / p.sum()
        var = {f: np.maximum(share[f] * (1 - share[f]), 0.02) for f in C.FIELDS}
        pool = {w: [sum(one[w, f][k] / (var[f] if k in (0, 2) else 1) for f in C.FIELDS) for k in range(4)] for w in who}
        every = np.maximum(sum(x[2] for x in pool.values()) / sum(x[3] for x in pool.values()), 1e-3)
        raw = {w: x[0] / x[1] / np.sqrt(np.maximum((x[2] + C.ALL_TRIPLETS * every) / (x[3] + C.ALL_TRIPLETS), 1e-3)) for w, x in pool.items()}
        mean = sum(raw[w] * total[w] for w in who) / sum(total.values())
        u = {w: np.clip((total[w] * raw[w] + C.MEAN_VOTES * mean) / (total[w] + C.MEAN_VOTES), -0.98, 0.98) for w in who}
    out = {}
    for (f, a), by in votes.items():
        score = np.log(share[f])
        for w, x in by.items():
            habit = (np.array(cast[w, f]) + 2 * share[f]) / (sum(cast[w, f]) + 2)
            hit, miss = np.clip(habit + (1 - share[f]) * u[w], 0.02, 0.98), np.clip(habit - share[f] * u[w], 0.01, 0.98)
            for t in ks:
                row = np.where(np.arange(3) == t, hit, miss)
                score[t] += np.log(row[C.LABELS.index(x)] / row.sum())
        out[a, f] = C.LABELS[int(np.argmax(np.round(score, 9)))]
    return out, share


@pytest.mark.parametrize("hot_votes", [100_000, 4])
def test_labels_equal_triplets_made_one_by_one(spark, hot_votes):
    """Also where most items are summed by salt."""
    rows, _ = simulated(150, 3)
    want, _ = moments_by_pairs(rows)
    got = {(r["item"], r["field"]): r["label"] for r in C.labelled(spark.createDataFrame(rows, SCHEMA).repartition(5), hot_votes=hot_votes).collect()}
    assert got == want


def test_share_from_moments():
    for p in (0.05, 0.2, 0.5, 0.8):
        d = 0.6
        assert C.share_by_triples(p * (1 - p) * d**2, p * (1 - p) * (1 - 2 * p) * d**3) == pytest.approx(p)


def test_many_annotators(spark):
    """More annotators than could be paired one with the other: each item has its own."""
    rows = [(i * 3 + k, f"a{i}", f"r{i % 1500}-{k}", "yes", "no" if k else "yes", "?", 1) for i in range(1500) for k in range(3)]
    got = {(r["audit_id"], r["field"]): r["label"] for r in C.found(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 4500 and {x for (_, f), x in got.items() if f == "direction_correct"} == {"no"}
    assert C.reviewers(spark.createDataFrame(rows, SCHEMA)).count() == 4500 * 3


def test_only_the_latest_decision_counts(spark):
    rows = [(1, "i", "a", "no", "Yes.", "?", 1), (2, "i", "a", "yes ", None, "", 5), (3, "i", "a", "yes ", None, "", 5), (4, "i", None, "no", "no", "no", 9), (5, None, "a", "no", "no", "no", 9), (6, "j", "b", "maybe", "", None, 1), (7, "k", "b", "UNCLEAR", "n", "y", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["audit_id"], r["field"]): r["label"] for r in C.found(df).collect()}
    assert got == {("i", "subject_correct"): "yes", ("k", "subject_correct"): "unclear", ("k", "direction_correct"): "no", ("k", "snippet_supports_claim"): "yes"}
    assert C.found(df.limit(0)).count() == 0 and C.reviewers(df.limit(0)).count() == 0
