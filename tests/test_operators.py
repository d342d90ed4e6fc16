"""Operators on small tables: expected results, and properties that must hold whatever the partitioning."""

import json

import pytest
from pyspark.sql import functions as F

from claimloom.operators import audit, benchmarks, claims, corpus, entities, evidence, graph, quality, retrieval, summaries, transcripts
from claimloom.sources import readers, writers
from claimloom.streaming import incremental

CLAIM = "claim_row_id bigint, pmid string, subject_type string, subject_name string, object_type string, object_name string, direction string, effect_direction string, health_interpretation string, effect_size string, p_value string, study_type string, evidence_snippet string"


def claim_table(spark, rows):
    full = [(i, p, "food", s, "outcome", o, d, "unclear", None, e, pv, st, "It fell.") for i, p, s, o, d, e, pv, st in rows]
    return spark.createDataFrame(full, CLAIM)


@pytest.fixture(scope="module")
def table(spark):
    return claim_table(
        spark,
        [
            (1, " 10 ", "Kefir", "body weight", "positive", "MD -1 kg", "<0.05", "RCT"),
            (2, "11", "kefir", "Body  Weight", "positive", None, None, "cohort"),
            (3, "12", "kefir", "body weight", "negative", None, None, None),
            (4, "13", "male sex", "body weight", "positive", None, None, None),
            (5, "14", "caffeine yogurt", "sleep", "positive", None, None, None),
            (6, "15", "yogurt", "sleep quality", "mixed", None, None, None),
            (7, None, "yogurt", None, "positive", None, None, None),
        ],
    )


def test_rejections_name_the_first_reason(table):
    got = {r["ordinal"]: r["reject_reason"] for r in claims.processed(table).collect()}
    assert got[1] is None and got[2] is None and got[3] is None
    assert got[4] == "scope" and got[5] == "scope" and got[6] == "direction" and got[7] == "no name"


def test_merging_takes_header_from_the_first_record(table):
    rows = {(r["direction"]): r for r in claims.from_raw(table).collect()}
    p = rows["positive"]
    assert (p["evidence_count"], p["n_articles"], p["first_seen"], p["last_updated"]) == (2, 2, "10", "11")
    assert p["subject"] == "kefir" and p["object"] == "body_weight"
    assert p["confidence"] == pytest.approx(min((0.7 + 0.5) / 2 + 0.2 + 0.1, 1.0))
    assert rows["negative"]["confidence"] == pytest.approx(0.5)
    listed = [r["pmid"] for r in claims.evidence(claims.accepted(claims.processed(table))).where(F.col("claim_id") == p["claim_id"]).orderBy("ordinal").collect()]
    assert listed == ["10", "11"]


def test_merging_does_not_depend_on_partitioning(table):
    a = sorted(map(str, claims.from_raw(table.repartition(7)).collect()))
    b = sorted(map(str, claims.from_raw(table.orderBy(F.desc("claim_row_id")).coalesce(1)).collect()))
    assert a == b


def test_empty_tables(spark):
    empty = claim_table(spark, []).limit(0)
    m = claims.from_raw(empty)
    assert m.count() == 0 and graph.nodes(m).count() == 0 and graph.edges(m).count() == 0
    assert graph.conflicts(m).count() == 0 and graph.similar_names(graph.entities(m).select("entity_type", "name")).count() == 0


def test_graph_and_edits(spark, table):
    m = claims.from_raw(table)
    nodes = {r["node_id"] for r in graph.nodes(m).where("node_type = 'entity'").collect()}
    assert nodes == {"food_kefir", "outcome_body_weight"}
    assert graph.edges(m).count() == 4
    assert [(r["subject"], r["object"]) for r in graph.conflicts(m).collect()] == [("kefir", "body_weight")]
    edits = spark.createDataFrame([("retype", "food", "kefir", "strain"), ("mark_out_of_scope", "food", "kefir", ""), ("set_name", "outcome", "body_weight", "Body weight"), ("delete_orphan", "food", "kefir", "")], "action string, entity_type string, name string, target string")
    e = graph.edited(m, edits)
    assert {r["subject_type"] for r in e.collect()} == {"strain"}
    assert {tuple(r["quality_flags"]) for r in e.collect()} == {("entity_out_of_scope:food:kefir",)}
    assert {r["object"] for r in e.collect()} == {"Body weight"}
    assert {r["claim_id"] for r in e.collect()} == {r["claim_id"] for r in m.collect()}
    asked = spark.createDataFrame([("407221a36b7d",)], "claim_id string")
    assert graph.details(m, asked).first()["found"] is False


def test_delta_of_a_run_with_itself_is_clean(table):
    m = claims.from_raw(table)
    assert quality.difference(m, m).count() == 0
    gone = quality.difference(m.where("direction = 'positive'"), m)
    assert {(r["kind"], r["change"]) for r in gone.collect()} == {("claim", "gone")}
    assert quality.recommendation({"suspicious_foods": 0}) == ["batch_looks_clean"]
    assert quality.recommendation({"suspicious_foods": 1}) == ["suspicious_foods_present"]


def test_quality_summary(table):
    rows = claims.processed(table)
    got = {r["measure"]: r["n"] for r in quality.summary(rows, claims.merged(claims.accepted(rows))).collect()}
    assert got["merged_claims"] == 2 and got["multi_evidence_claims"] == 1 and got["rejected"] == 4


def test_review_candidates(spark):
    review = "# Report\n### ISSUE-001: [duplicate] - kefir (food)\n- **Severity**: major\n- **Action**: merge into kefir\n### ISSUE-002: [drift] - tea (food)\n- **Severity**: critical\n- **Action**: preserve\n### Summary\nnothing"
    c = quality.issues(spark.createDataFrame([(1, review)], "review_id int, review string"))
    assert [(r["issue_id"], r["action"], r["severity"]) for r in c.orderBy("pos").collect()] == [("ISSUE-001", "merge", "major"), ("ISSUE-002", "preserve", "critical")]
    assert [r["issue_id"] for r in quality.selected(c, 1).collect()] == ["ISSUE-001"]


def test_similar_names_equal_brute_force(spark):
    import random

    random.seed(3)
    names = sorted({"_".join(random.choices(["plasma", "fecal", "milk", "kefir", "goat", "soy", "water", "tea", "black"], k=random.randint(1, 4))) for _ in range(150)})
    df = spark.createDataFrame([("x", n) for n in names], "entity_type string, name string")
    got = {(r["entity_a"], r["entity_b"]) for r in graph.similar_names(df, threshold=0.6).collect()}
    sets = {n: set(n.split("_")) for n in names}
    want = {(a, b) for a in names for b in names if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6 - 1e-9}
    assert got == want


def test_greedy_merging_follows_first_sight(spark):
    names = spark.createDataFrame([("food", "kombucha", 1), ("food", "kombucha_tea", 2), ("food", "tea", 3), ("food", "other", 4)], "entity_type string, key string, first_id int")
    pairs = spark.createDataFrame([("food", "kombucha", "kombucha_tea", 0.95), ("food", "kombucha_tea", "tea", 0.95)], "entity_type string, entity_a string, entity_b string, similarity double")
    got = {r["key"]: r["canonical"] for r in entities.merged_greedily(names, pairs).collect()}
    assert got == {"kombucha": "kombucha", "kombucha_tea": "kombucha", "tea": "tea", "other": "other"}
    shuffled = {r["key"]: r["canonical"] for r in entities.merged_greedily(names.repartition(5), pairs.repartition(3)).collect()}
    assert shuffled == got


def test_article_resolution(spark):
    meta = spark.createDataFrame([("12345", "T", "x" * 10), ("2", "U", "")], "pmid string, title string, abstract string")
    sel = spark.createDataFrame([(" 12345\n", "S", "y" * 12), ("2", "S", "y"), ("3", "S", "own"), ("4", "S", "")], "pmid string, title string, abstract string")
    got = {r["pmid"]: (r["title"], r["text_source"]) for r in corpus.resolved(sel, meta).collect()}
    assert got == {"12345": ("T", "metadata"), "2": ("U", "selected"), "3": ("S", "selected")}


def test_paper_grade(spark):
    row = [("1", "Trial", "A total of 250 subjects were enrolled", [("Randomized Controlled Trial",)], [("A", ["Harvard Medical School"])], None, [("NIH", "1")], "Gut Ecology")]
    a = spark.createDataFrame(row, "pmid string, title string, abstract string, publication_types array<struct<name:string>>, authors_full array<struct<name:string,affiliations:array<string>>>, author_affiliations array<string>, grants array<struct<agency:string,grant_id:string>>, journal string")
    funders = {"government": ("NIH",), "non_profit": (), "industry": (), "academic": ()}
    ranking = spark.createDataFrame([(0, "Gut Ecology", 12.0)], "ordinal int, title string, sjr double")
    ranked = corpus.paper_scores(a, ("Harvard",), funders, ranking).first()
    assert (ranked["journal_score"], ranked["journal_tier"]) == (10.0, "top") and ranked["total"] == pytest.approx(7.6 + 7 * 0.2)
    unnamed = corpus.paper_scores(a.withColumn("journal", F.lit(None).cast("string")), ("Harvard",), funders, ranking).first()
    assert (unnamed["journal_score"], unnamed["journal_tier"]) == (0.0, "unknown")
    r = corpus.paper_scores(a, ("Harvard",), funders, ranking.limit(0)).first()  # no list: unranked, 3 points
    assert (r["study_score"], r["sample_score"], r["institution_score"], r["funding_score"], r["grade"]) == (10.0, 8.0, 6.0, 10.0, "B+")
    assert r["total"] == pytest.approx(7.6)


def test_journal_match(spark):
    j = spark.createDataFrame([(0, "Gut"), (1, "Gut Ecology"), (2, "Milk")], "ordinal int, title string")
    got = {r["journal"]: (r["title"], r["how"]) for r in corpus.journal_match(spark.createDataFrame([("gut ecology",), ("Journal of Gut Ecology",), ("Tea",), (None,)], "journal string"), j).collect()}
    assert got == {"gut ecology": ("gut ecology", "exact"), "journal of gut ecology": ("gut", "contained"), "tea": (None, "none")}


def test_retrieval_metrics(spark):
    items = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(1, 9)] + [(99, None)], "item_id bigint, vector array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "query_id bigint, vector array<float>")
    hits = retrieval.vector_search(q, items, 5, dim=2, block=1)
    assert [(r["item_id"], r["rank"]) for r in hits.orderBy("query_id", "rank").collect()] == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]
    gold = spark.createDataFrame([(1, 3), (1, 77), (2, 1)], "query_id bigint, item_id bigint")
    m = {r["query_id"]: r for r in retrieval.metrics(hits, gold).collect()}
    assert m[1]["reciprocal_rank"] == pytest.approx(1 / 3, abs=1e-6) and m[1]["hit_1"] == 0 and m[1]["recall_3"] == 0.5
    assert m[2]["reciprocal_rank"] == 0 and m[2]["recall_20"] == 0
    for a, b in zip(retrieval.CUTS, retrieval.CUTS[1:], strict=False):
        assert all(r[f"recall_{a}"] <= r[f"recall_{b}"] for r in m.values())


def test_lexical_scores(spark):
    q = spark.createDataFrame([(1, "Does kefir lower body weight?")], "query_id bigint, query string")
    i = spark.createDataFrame([("a", "kefir has positive effect on body weight", ["kefir", "body weight"]), ("b", "tea has effect on sleep", ["tea"])], "item_id string, text string, phrases array<string>")
    got = {r["item_id"]: r["score"] for r in retrieval.lexical_top(q, i, 5, common=0.9).collect()}
    assert got == {"a": pytest.approx(3 / (5**0.5 * 7**0.5) + 0.5, abs=1e-6)}


def test_audit(spark):
    rows = [("i1", "r1", 1, "yes"), ("i1", "r2", 2, "Yes."), ("i2", "r1", 3, "no"), ("i2", "r2", 4, "y"), ("i2", "r1", 5, "n"), ("i3", "r1", 6, None), ("i3", "r2", 7, "?")]
    df = spark.createDataFrame([(a, b, c, c, d) for a, b, c, d in rows], "audit_id string, reviewer_id string, decision_id int, decided_at int, f string")
    labels = audit.long_labels(df, ["f"])
    pairs = audit.double_reviews(labels)
    assert {(r["audit_id"], r["a"], r["b"]) for r in pairs.collect()} == {("i1", "yes", "yes"), ("i2", "no", "yes")}
    assert {r["audit_id"]: r["label"] for r in audit.resolved(pairs).collect()} == {"i1": "yes", "i2": "no"}
    same = pairs.select("audit_id", "field", "a", F.col("a").alias("b"))
    assert audit.kappa(same).first()["kappa"] == 1.0
    assert audit.crosstab(pairs).count() == 3
    s = audit.stratified(labels, "label", "decision_id", {"yes": 1}, "x")
    assert s.count() == 1


def test_rule_claims_and_backfill(spark):
    a = spark.createDataFrame([("1", "The aim was to test. Probiotic yogurt reduced total cholesterol (P = 0.01). Probiotic intake did not change nausea significantly.")], "pmid string, abstract string")
    got = evidence.rule_claims(evidence.result_sentences(a)).orderBy("claim_ordinal").collect()
    assert [(r["outcome"], r["direction"], r["effect_direction"]) for r in got] == [("total_cholesterol", "positive", "decreased"), ("nausea", "neutral", "no_significant_effect")]
    c = spark.createDataFrame([(1, "1", "probiotic_yogurt", "total_cholesterol", "positive", None, "P = 0.01")], "ordinal int, pmid string, subject string, object string, direction string, effect_size string, p_value string")
    assert evidence.backfilled(c, a).first()["snippet"].startswith("Probiotic yogurt reduced")


def test_benchmarks(table):
    m = claims.from_raw(table)
    assert [r["subject"] for r in benchmarks.seeds(m, 5).collect()] == ["kefir"]
    rows = claims.accepted(claims.processed(table))
    gold = rows.select(F.col("ordinal").alias("item_id"), "pmid", "subject", "object", "direction")
    assert {r["item_id"] for r in benchmarks.repaired_gold(gold, rows).collect()} == {1, 2, 3}
    top = gold.select("item_id", "pmid", F.lit(1).alias("rank"))
    assert {r["category"] for r in benchmarks.compatibility(gold, rows, top).collect()} == {"all_gold_pmids_retrieved_top10"}
    assert {r["category"] for r in benchmarks.compatibility(gold, rows, top.withColumn("rank", F.lit(15))).collect()} == {"gold_pmids_rank_11_20"}
    assert {r["category"] for r in benchmarks.compatibility(gold, rows, top.limit(0)).collect()} == {"anchor_claim_present_but_not_retrieved_top20"}
    assert {r["category"] for r in benchmarks.compatibility(gold, rows.limit(0), top).collect()} == {"gold_pmids_absent_from_new_graph"}


def test_transcripts(spark):
    calls = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 4, "c")], "item_id int, ordinal int, command string")
    per = {r["item_id"]: r for r in transcripts.call_statistics(calls).collect()}
    assert (per[1]["n_calls"], per[1]["repeats"], per[1]["most_called"]) == (3, 1, "a")
    s = {r["group"]: r for r in transcripts.call_summary(transcripts.call_statistics(calls).withColumn("k", F.lit("x")), "k").collect()}
    assert (s["all"]["median"], s["all"]["p90"], s["all"]["most"]) == (2.0, 1, 3)
    a = spark.createDataFrame([(1, "PMID 123456 and 407221a36b7d"), (2, "no evidence")], "item_id int, response string")
    g = spark.createDataFrame([(1, "123456"), (1, "999999")], "item_id int, pmid string")
    got = {r["item_id"]: r for r in transcripts.scored_answers(a, g).collect()}
    assert got[1]["pmid_recall"] == 0.5 and got[1]["n_claims"] == 1 and got[2]["pmid_hit"] is None and got[2]["abstains"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"papers": [{"pmid": "1", "title": ""}, {"pmid": "2"}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"pmid": "3"}]))
    assert {r["pmid"] for r in readers.documents(spark, str(tmp_path / "*.json"), "pmid string, title string").collect()} == {"1", "2", "3"}
    (tmp_path / "l.jsonl").write_text('{"pmid": "1", "n": 1}\nbroken\n{"pmid": "1", "n": 2}\n')
    assert [r["n"] for r in readers.json_lines(spark, str(tmp_path / "l.jsonl"), "pmid string, n int", key="pmid").collect()] == [2]
    (tmp_path / "j.csv").write_text('Title;Issn;SJR;H index;SJR Best Quartile;Publisher;Country\n"Gut";1;12,5;x;;P;C\nMilk;2;bad;7;Q1;P;C\ngut;3;9,0;8;Q2;P;C\n')
    j = {r["key"]: r for r in readers.journals(spark, str(tmp_path / "j.csv")).collect()}
    assert j["gut"]["sjr"] == 9.0 and j["gut"]["quartile"] == "Q2" and j["milk"]["sjr"] == 0.0 and j["gut"]["ordinal"] < j["milk"]["ordinal"]
    (tmp_path / "e.json").write_text(json.dumps({"ids": ["a", "b"], "texts": ["x", "y"], "embeddings": [[1, 2], [3, 4]]}))
    assert [tuple(r["embedding"]) for r in readers.embeddings(spark, str(tmp_path / "e.json")).orderBy("id").collect()] == [(1.0, 2.0), (3.0, 4.0)]
    x = spark.createDataFrame([("<article><front><article-id pub-id-type='pmid'>7</article-id><article-title>T</article-title><abstract><p>A b</p></abstract></front><body><sec><title>Methods</title><p>One</p></sec></body></article>",)], "xml string")
    r = readers.full_text_xml(x).first()
    assert (r["pmid"], r["title"], r["abstract"], r["section_titles"], r["body_text"]) == ("7", "T", "A b", ["Methods"], "One")
    df = spark.createDataFrame([("1", ["a", "b"], 0.5)], "pmid string, all_pmids array<string>, s double")
    writers.delimited(df, str(tmp_path / "out"))
    assert readers.delimited(spark, str(tmp_path / "out"), "pmid string, all_pmids string, s string").first()["all_pmids"] == "a;b"
    assert "| 1 | ['a', 'b'] | 0.5000 |" in writers.markdown(df)
    assert writers.unfinished(df, df, "pmid").count() == 0


def test_streamed_merge_equals_batch(spark, table, tmp_path):
    table.repartition(3).write.parquet(str(tmp_path / "claims"))
    again = table.where("claim_row_id = 1")
    again.write.mode("append").parquet(str(tmp_path / "claims"))
    a = sorted(map(str, incremental.merge_directory(spark, str(tmp_path / "claims"), "t").collect()))
    assert a == sorted(map(str, claims.from_raw(table).collect()))


@pytest.mark.parametrize("block", [7, 40, 1000])
def test_check_points_in_blocks_equal_one_sequence(spark, block):
    import random

    random.seed(block)
    steps = [(f"run{r}", i, random.choice([0, 1, 9, 30]), random.choice([0, 0, 0, 1])) for r in range(3) for i in range((120, 1, 33)[r])]
    got = {(r["run_id"], r["ordinal"]): r["stop"] for r in incremental.check_points(spark.createDataFrame(steps, "run_id string, ordinal bigint, new_entities int, warnings int").repartition(4), block=block).collect()}
    want = {}
    for run in {s[0] for s in steps}:
        mine = [s for s in steps if s[0] == run]
        want |= {(run, s[1]): x for s, x in zip(mine, incremental.stops([(1, s[2], s[3]) for s in mine]), strict=True)}
    assert got == want


def test_check_points():
    assert incremental.stops([(1, 0, 0)] * 3, articles=2) == [False, True, True]
    assert incremental.stops([(1, 80, 0), (1, 0, 1), (1, 0, 2)]) == [True, False, True]
    assert incremental.stops([]) == []


def test_candidate_names_equal_brute_force(spark):
    import random

    random.seed(5)
    names = sorted({"_".join(random.choices(["milk", "buttermilk", "a", "kvass", "ka", "apple", "soy", "tea", "steak", "", "oat"], k=random.randint(1, 5))) for _ in range(250)} - {""} | {"milk", "milk_soy", "a", "steak"})
    df = spark.createDataFrame([(t, n) for n in names for t in ("food", "strain")][:-1], "entity_type string, name string")

    def score(a, b):
        x, y = set(a.split("_")), set(b.split("_"))
        return max(len(x & y) / len(x | y), 0.75 if a in b or b in a else 0)

    got = {(r["entity_a"], r["entity_b"]): r["similarity"] for r in graph.candidate_names(df).where("entity_type = 'food'").collect()}
    assert got == {(a, b): round(score(a, b), 6) for a in names for b in names if a < b and score(a, b) >= 0.45}
    assert got["milk", "milk_soy"] >= 0.75 and any("steak" in k[1] and k[0] == "a" for k in got)
    high = {(r["entity_a"], r["entity_b"]) for r in graph.candidate_names(df, least=0.92).where("entity_type = 'food'").collect()}
    assert high == {k for k, v in got.items() if v >= 0.92}


def test_greedy_merging_is_for_foods_and_outcomes_from_092(spark):
    names = spark.createDataFrame([(t, n, i) for t in ("food", "strain") for i, n in enumerate(["soy_tea", "milk_tea", "tea_milk", "milk"])] + [("food", "b", 11), ("food", "a", 12), ("food", "c", 13)], "entity_type string, key string, first_id int")
    pairs = graph.candidate_names(names.select("entity_type", F.col("key").alias("name"))).unionByName(spark.createDataFrame([("food", "a", "c", 0.95), ("food", "b", "c", 0.95)], "entity_type string, entity_a string, entity_b string, similarity double"))
    got = {(r["entity_type"], r["key"]): r["canonical"] for r in entities.merged_greedily(names, pairs).collect()}
    assert {k: v for k, v in got.items() if k[1] != v} == {("food", "tea_milk"): "milk_tea", ("food", "c"): "b"}


@pytest.mark.parametrize("n", [4, 90])
def test_diversified_claims_follow_the_reference(spark, n):
    import random

    random.seed(n)
    rows = [(f"c{i:03}", random.choice("abcdefgh"), random.choice("xyz"), random.randint(1, 4), random.choice([0.5, 0.9])) for i in range(120)]
    ranked = sorted(rows, key=lambda r: (-r[3], -r[4], r[1], r[2], r[0]))
    selected, subjects, pairs = [], set(), set()
    for r in ranked:
        if r[1:3] in pairs or r[1] in subjects and len(selected) < n:
            continue
        selected.append(r)
        subjects.add(r[1])
        pairs.add(r[1:3])
    want = selected + [r for r in ranked if r not in selected]
    got = benchmarks.diversified(spark.createDataFrame(rows, "claim_id string, subject string, object string, evidence_count bigint, confidence double"), n).collect()
    assert [r["claim_id"] for r in got] == [r[0] for r in want]


def test_rule_claims_query_has_all_outcome_groups():
    from claimloom import lexicons
    from claimloom.plans import evidence as plans

    assert all(set(v) <= set(plans._EVERY_OUTCOME[k]) for d in (lexicons.OUTCOME_ALIASES, plans.OUTCOMES) for k, v in d.items())
    assert set(lexicons.RETRY_SUBJECTS) | set(plans.SUBJECTS) == set(plans._EVERY_SUBJECT)


def test_claims_follow_the_rules_of_rejection_and_health(spark):
    base = ("10", "food", "kefir", "outcome")
    rows = [
        (1, *base, "cholesterol", "positive", "no significant effect", "beneficial", None, None, "RCT", "We aimed to study kefir."),
        (2, *base, "cholesterol", "positive", "decreased", "unclear", None, None, "RCT", "We aimed to study kefir."),
        (3, *base, "some thing", "positive", "unclear", "unclear", None, None, "RCT", "This study aimed to test kefir."),
        (4, *base, "some thing", "positive", "unclear", "unclear", None, None, "RCT", "It was so."),
        (5, "10", "food", "kefir", "food", "placebo", "positive", "unclear", "unclear", None, None, "RCT", "It was so."),
    ]
    got = {r["ordinal"]: r for r in claims.processed(spark.createDataFrame(rows, CLAIM)).collect()}
    assert (got[1]["health_interpretation"], got[1]["direction"], got[1]["reject_reason"]) == ("neutral", "neutral", None)
    assert (got[2]["health_interpretation"], got[2]["direction"], got[2]["reject_reason"]) == ("beneficial", "positive", None)
    assert got[3]["reject_reason"] == "no result" and got[4]["reject_reason"] is None and got[5]["reject_reason"] == "object"


def test_a_blank_study_type_counts_as_a_kind(spark):
    t = claim_table(spark, [(1, "1", "kefir", "body weight", "positive", None, None, "RCT"), (2, "2", "kefir", "body weight", "positive", None, None, None)])
    assert claims.from_raw(t).first()["confidence"] == pytest.approx(0.5 + 0.2 + 0.1)


def test_counts_of_batches_add_up(table):
    rows = claims.accepted(claims.processed(table))
    parts = claims.counted(rows.where("ordinal % 2 = 0")).unionByName(claims.counted(rows.where("ordinal % 2 = 1")))
    assert sorted(map(str, claims.finished(claims.united(parts)).collect())) == sorted(map(str, claims.merged(rows).collect()))


def test_graph_edits_keep_to_their_contract(spark):
    t = claim_table(spark, [(1, "1", "kefir", "body weight", "positive", None, None, "RCT"), (2, "2", "yogurt", "body weight", "positive", None, None, None), (3, "3", "kimchi", "sleep quality", "positive", None, None, None)])
    m = claims.from_raw(t)
    alone = spark.createDataFrame([("food", "placeholder")], "entity_type string, name string")
    edits = [
        ("set_name", "food", "kefir", "Milk kefir"), ("merge", "food", "nobody", "yogurt"), ("merge", "food", "nobody", "nothing"), ("rename", "food", "kimchi", "yogurt"), ("retype", "outcome", "sleep_quality", "symptom"),
        ("delete_orphan", "food", "placeholder", ""), ("delete_orphan", "food", "yogurt", ""), ("mark_out_of_scope", "food", "yogurt", "drift"), ("retype", "food", "absent", "strain"), ("paint", "food", "kefir", "blue"),
    ]
    e = spark.createDataFrame(edits, "action string, entity_type string, name string, target string")
    why = {(r["action"], r["name"], r["target"]): r["reason"] for r in graph.edit_results(m, e, alone).collect()}
    assert why == {
        ("set_name", "kefir", "Milk kefir"): None, ("merge", "nobody", "yogurt"): None, ("merge", "nobody", "nothing"): "neither exists", ("rename", "kimchi", "yogurt"): "new name exists", ("retype", "sleep_quality", "symptom"): None,
        ("delete_orphan", "placeholder", ""): None, ("delete_orphan", "yogurt", ""): "has claims", ("mark_out_of_scope", "yogurt", "drift"): None, ("retype", "absent", "strain"): "no such entity", ("paint", "kefir", "blue"): "unknown action",
    }
    nodes = {r["node_id"]: (r["display_name"], r["quality_status"]) for r in graph.edited_nodes(m, e, alone).collect()}
    assert nodes == {"food_kefir": ("Milk kefir", None), "food_yogurt": (None, "out_of_scope"), "food_kimchi": (None, None), "outcome_body_weight": (None, None), "symptom_sleep_quality": (None, None)}
    got = {r["subject_id"]: r for r in graph.edited(m, e, alone).collect()}
    assert got["food_kefir"]["subject"] == "Milk kefir" and got["food_kimchi"]["object_id"] == "symptom_sleep_quality"
    assert got["food_yogurt"]["quality_flags"] == ["entity_out_of_scope:food:yogurt"]


def test_lexical_search_equals_all_pairs(spark):
    import random

    random.seed(4)
    vocabulary = ["has", "effect", "on", "kefir", "milk", "tea", "sleep", "weight", "liver", "oat", "rice", "miso"]
    items = [(f"i{n}", f"{a} has effect on {b}", [a, b, "oat"]) for n in range(60) for a, b in [random.sample(vocabulary[3:], 2)]]
    queries = [(n, " ".join(random.choices(vocabulary, k=random.randint(1, 6)))) for n in range(25)] + [(99, "has goat effect"), (98, "zzz")]
    from collections import Counter

    want = {}
    for q, t in queries:
        a, scored = Counter(t.split()), []
        for i, x, ps in items:
            b = Counter(x.split())
            o = sum((a & b).values())
            if o:
                scored.append((-round(o / (sum(v * v for v in a.values()) ** 0.5 * sum(v * v for v in b.values()) ** 0.5) + 0.25 * sum(p in t for p in ps), 6), i))
        want[q] = sorted(scored)[:5]
    df, qs = spark.createDataFrame(items, "item_id string, text string, phrases array<string>"), spark.createDataFrame(queries, "query_id bigint, query string")
    for common in (0.05, 0.3, 1.0):
        got = {}
        for r in retrieval.lexical_top(qs, df, 5, common=common).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((-r["score"], r["item_id"]))
        assert {q: [i for _, i in x] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items() if x}


def test_lexical_search_shuffles_no_pairs(spark):
    def shuffled() -> int:
        jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    words = [f"w{n}" for n in range(25)]  # each in 4 % of the items
    items = spark.createDataFrame([(f"i{n:04}", f"{words[n % 25]} x{n}", [words[n % 25]]) for n in range(3000)], "item_id string, text string, phrases array<string>")
    queries = spark.createDataFrame([(n, f"v{n} {words[n % 25]}") for n in range(600)], "query_id bigint, query string")
    before = shuffled()
    got = retrieval.lexical_top(queries, items, 5).collect()
    assert shuffled() - before < 20_000  # 600 queries share a word with 120 items each
    # w1 is part of the text of w10 as well, but only as a phrase
    assert {r["query_id"]: r["item_id"] for r in got if r["rank"] == 5} == {n: f"i{n % 25 + 100:04}" for n in range(600)}
    assert {r["score"] for r in got} == {0.75}


def test_lexical_search_in_blocks(spark):
    items = spark.createDataFrame([(f"i{n:02}", ["tea has effect", "tea tea", "oat milk, tea", None, ""][n % 5], [["tea"], ["oat milk", None], [""], None][n % 4]) for n in range(60)] + [(None, "tea", ["tea"])], "item_id string, text string, phrases array<string>")
    queries = spark.createDataFrame([(1, "tea"), (2, "Tea"), (3, "oat milk tea tea"), (4, None), (5, "tea"), (None, "tea")], "query_id bigint, query string")
    one, many = (sorted(map(tuple, retrieval.lexical_top(queries, items, 7, block=b, rows=r).collect())) for b, r in ((100, 100), (1, 9)))
    assert one == many and {r[0] for r in one} == {1, 2, 3, 5} and len(one) == 28
    assert [r[1:] for r in one if r[0] == 1] == [r[1:] for r in one if r[0] == 5]


def test_heads_of_merged_claims(table):
    rows = claims.accepted(claims.processed(table))
    c = ["claim_id", "subject", "object", "claim_text"]
    assert sorted(map(tuple, claims.heads(rows).select(*c).collect())) == sorted(map(tuple, claims.merged(rows).select(*c).collect()))


def test_vector_search_in_blocks(spark):
    import numpy as np

    x = np.random.default_rng(3).normal(size=(90, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8)], "item_id bigint, vector array<double>")
    q = df.select(F.col("item_id").alias("query_id"), "vector")
    a, b = (sorted(map(tuple, retrieval.vector_search(q, df, 3, dim=8, block=bl, rows=ro).collect())) for bl, ro in ((4096, 65536), (20, 13)))
    assert [r[:2] for r in a] == [r[:2] for r in b] and len(a) == 270


def test_greedy_merging_in_rounds_equals_one_pass(spark):
    import random

    random.seed(6)
    keys = [f"n{i:02}" for i in range(40)]
    first = {k: i for i, k in enumerate(random.sample(keys, len(keys)))}
    sim = {(a, b): round(random.uniform(0.9, 1.0), 2) for a in keys for b in keys if a < b and random.random() < 0.15}
    near = lambda a, b: sim.get((min(a, b), max(a, b)), 0)
    want = {}
    for k in sorted(keys, key=first.get):
        best = min(((-near(k, o), first[o], o) for o in want if want[o] == o and near(k, o) >= 0.92), default=None)
        want[k] = best[2] if best else k
    names = spark.createDataFrame([("food", k, first[k]) for k in keys], "entity_type string, key string, first_id bigint")
    pairs = spark.createDataFrame([("food", a, b, s) for (a, b), s in sim.items()], "entity_type string, entity_a string, entity_b string, similarity double")
    assert {r["key"]: r["canonical"] for r in entities.merged_greedily(names, pairs).collect()} == want


def test_quotas_round_half_to_even():
    assert summaries.quotas(50, benchmarks.TYPE_SHARES, "comparison") == {"description": 17, "evidence_lookup": 10, "reason": 10, "comparison": 13}
    assert sum(summaries.quotas(37, benchmarks.TYPE_SHARES, "comparison").values()) == 37


def test_summaries_of_nothing(spark):
    empty = spark.createDataFrame([], "relevance string, confidence double")
    assert summaries.relevance(empty).first()["total"] == 0
