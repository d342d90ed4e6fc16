"""Copies against brute force, hot keys, notations and odd records."""

import json
import random

from claimloom.llm import duplicates as D

CLAIM = "claim_row_id bigint, pmid string, subject_name string, object_name string, direction string"


def bare(s):
    return "".join(c for c in s if c.isalnum()).upper().lower() if s else ""


def brute(rows):
    groups = {}
    for i, p, *f in rows:
        key = ((p or "").strip(), *map(bare, f))
        if all(key):
            groups.setdefault(key, []).append(i)
    return {(min(g), i) for g in groups.values() for i in g if i != min(g)}


def variants(n, seed=0):
    random.seed(seed)
    rows = []
    for i in range(1, n + 1):
        s, o, d = random.choice(["soy yogurt", "Kefir", "café au lait", "straße", None, "--"]), random.choice(["uric acid", "TNF-α", ""]), random.choice(["positive", "negative", None])
        shape = lambda x: x and random.choice([x, x.upper(), x.replace(" ", "_"), f" {x}. ", f"'{x}'", x.replace(" ", " ")])
        rows.append((i, random.choice([" 1 ", "1", "2", None, " "]), shape(s), shape(o), shape(d)))
    random.shuffle(rows)
    return rows


def test_copies_equal_brute_force_hot_or_not(spark):
    rows = variants(800)
    df = spark.createDataFrame(rows, CLAIM)
    records = D.claim_records(df)
    want = brute(rows)
    for hot in (10**6, 20, 1):
        assert {tuple(r) for r in D.copies(records, hot_rows=hot, salts=3).collect()} == want
    sizes = {}
    for k, _ in want:
        sizes[k] = sizes.get(k, 1) + 1
    for hot in (10**6, 5):
        got = {r["keep_id"]: r["copies"] for r in D.collapse(records, hot_rows=hot, salts=3).collect()}
        assert {k: n for k, n in got.items() if n > 1} == sizes


def test_notations(spark):
    rows = [
        (1, '{"subject_name": "soy; yogurt | x", "direction":"Positive ", "object_name": "IL\\u00a06"}'), (2, "object_name: IL-6 | direction: positive | subject_name: Soy yogurt | X"), (3, "SUBJECT_NAME=soy yogurt X; DIRECTION=positive;OBJECT_NAME=il6"),
        (4, '{\n "Direction" : "positive" , \n "subject_name" : "SOY_YOGURT_X" , \n "object_name" : "IL 6"\n}'), (5, "{broken"), (6, None), (7, ""), (8, json.dumps({"subject_name": None, "object_name": "a", "direction": "b"})), (8, json.dumps({"subject_name": None, "object_name": "a", "direction": "b"})),
    ]
    raw = spark.createDataFrame([(i, "9", t, "clash") for i, t in rows], "raw_id bigint, pmid string, record_text string, direction string")
    assert {tuple(r) for r in D.found(spark.createDataFrame([], CLAIM), raw).collect()} == {("raw_claims", 1, i) for i in (2, 3, 4)}


def test_repeated_and_empty(spark):
    df = spark.createDataFrame([(5, "1", "a", "b", "c"), (5, "1", "a", "b", "c"), (3, "1", "A", "B.", "C"), (None, "1", "a", "b", "c"), (9, "1", "x" * 100_000, "b", "c")], CLAIM)
    assert [tuple(r) for r in D.copies(D.claim_records(df)).collect()] == [(3, 5)]
    assert D.copies(D.claim_records(df.limit(0))).count() == 0 and D.collapse(D.claim_records(df.limit(0))).count() == 0


def test_collapsed_holds_every_record_of_both_tables(spark):
    rows = variants(300, 4)
    texts = [(1, "9", "object_name: IL-6 | direction: positive | subject_name: Soy"), (2, "9", "SUBJECT_NAME=soy; DIRECTION=positive;OBJECT_NAME=il6"), (3, "9", "{broken"), (4, None, "x"), (4, None, "x"), (None, "9", "x"), (5, "9", None)]
    claims, raw = spark.createDataFrame(rows + rows[:5], CLAIM), spark.createDataFrame(texts, "raw_id bigint, pmid string, record_text string")
    groups = {}
    for k, i in brute(rows):
        groups.setdefault(k, {k}).add(i)
    spare = {i for g in groups.values() for i in g} - set(groups)
    want = {("extracted_claims", i, len(groups.get(i, {i}))) for i, *_ in rows if i not in spare} | {("raw_claims", 1, 2), ("raw_claims", 3, 1), ("raw_claims", 4, 1), ("raw_claims", 5, 1)}
    for hot in (10**6, 5):
        got = [tuple(r) for r in D.collapsed(claims, raw, hot_rows=hot, salts=3).collect()]
        assert sorted(got) == sorted(want)
    assert D.collapsed(claims.limit(0), raw.limit(0)).count() == 0
