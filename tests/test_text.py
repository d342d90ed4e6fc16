"""Expressions on small inputs with known results."""

import pytest
from pyspark.sql import functions as F

from claimloom.functions import text, vectors


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("subject", "outcome", "direction", "expected"),
    [
        ("yogurt", "ldl_cholesterol", "positive", "407221a36b7d"),
        ("probiotic_yogurt", "ldl_cholesterol", "positive", "01e523949fe7"),
        ("probiotic_yogurt", "ldl_cholesterol", "negative", "1ab89c45e326"),
        ("kombucha", "antimicrobial_activity", "positive", "7467b2d64d37"),
        ("kefir", "helicobacter_pylori_eradication", "positive", "e0cc0207281e"),
        ("fermented_foods", "type_2_diabetes", "positive", "dee63f484b57"),
        ("kimchi", "immune_function", "positive", "57dfdf161a33"),
    ],
)
def test_claim_ids(spark, subject, outcome, direction, expected):
    row = spark.createDataFrame([(subject, outcome, direction)], "s string, o string, d string").select(text.claim_id(F.col("s"), F.col("o"), F.col("d")).alias("i")).first()
    assert row["i"] == expected


def test_effects_and_health(spark):
    assert one(spark, " Reduced ", text.effect_direction) == "decreased"
    assert one(spark, None, text.effect_direction) == "unclear"
    assert one(spark, "sideways", text.effect_direction) == "unclear"
    assert one(spark, "Protective", text.health_interpretation) == "beneficial"
    rows = spark.createDataFrame([("decreased", "LDL cholesterol"), ("increased", "HDL cholesterol"), ("increased", "bone mineral density"), ("no_significant_effect", "x"), ("changed", "x")], "e string, o string")
    assert [r[0] for r in rows.select(text.inferred_health(F.col("e"), F.col("o"))).collect()] == ["beneficial", "harmful", "beneficial", "neutral", "unclear"]


def test_direction_falls_back_and_may_be_empty(spark):
    rows = spark.createDataFrame([("positive", "unclear", "unclear", ""), ("mixed", "unclear", "unclear", ""), ("positive", "no_significant_effect", "unclear", ""), ("negative", "increased", "beneficial", "")], "v string, e string, h string, o string")
    got = [r[0] for r in rows.select(text.claim_direction(F.col("v"), F.col("e"), F.col("h"), F.col("o"))).collect()]
    assert got == ["positive", "", "neutral", "positive"]


@pytest.mark.parametrize(("name", "normal", "valid"), [("male_sex", "male_sex", False), ("Greek Yoghurt ", "greek_yoghurt", True), ("kephir", "kefir", True), ("week12", "week12", False), ("  ", "", False), ("yogurt containing L. casei", "probiotic_yogurt", True)])
def test_foods(spark, name, normal, valid):
    assert one(spark, name, text.food_name) == normal
    assert one(spark, name, lambda c: text.food_is_valid(text.food_name(c))) is valid


@pytest.mark.parametrize(("name", "valid"), [("Lactobacillus rhamnosus GG", True), ("L. casei Shirota", True), ("bifidobacterium longum BB536", True), ("probiotic", False), ("Lactobacillus", False), (None, False), ("Bifidobacterium animalis subsp. lactis BB-12", True), ("Lactobacillus plantarum Sona-1", False)])
def test_strains(spark, name, valid):
    # the last one contains "na", which is on the list of names that mean none
    assert one(spark, name, text.strain_is_valid) is valid


def test_strain_parts(spark):
    p = one(spark, "Bifidobacterium longum subsp. infantis M-63", text.strain_parts)
    assert (p["genus"], p["species"], p["subspecies"], p["strain"]) == ("Bifidobacterium", "longum", "infantis", "M-63")
    p = one(spark, "L. casei Shirota", text.strain_parts)
    assert (p["genus"], p["species"], p["strain"]) == ("L", "casei", "Shirota")


def test_sentences_and_patterns(spark):
    assert one(spark, "A fell (P < .05). B rose. c stayed", text.sentences) == ["A fell (P < .05).", "B rose. c stayed"]
    assert one(spark, "found P = 0.03 there", text.p_value) == "P = 0.03"
    assert one(spark, "none", text.p_value) is None
    assert one(spark, "A total of 250 subjects were enrolled, n = 12", text.largest_sample) == 12
    assert one(spark, "for 12 weeks", text.duration_days) == 84
    d = one(spark, "took 2 x 10^9 CFU/day", text.dose)
    assert (d["value"], d["unit"]) == (2e9, "CFU/day")
    assert one(spark, "PMID: 123456, PMID 123456 and PMID:7654321", text.cited_pmids) == ["123456", "7654321"]
    assert one(spark, 'text ```json\n{"a": 1}\n``` more', text.json_object) == '{"a": 1}'
    assert one(spark, "There is no direct evidence", text.abstains) is True


@pytest.mark.parametrize(("given", "expected"), [("update_type", "retype"), ("Delete orphan", "delete_orphan"), ("title case", "set_name"), ("mark out-of-scope", "mark_out_of_scope"), ("manual_review", "preserve"), ("dance", "skip")])
def test_actions(spark, given, expected):
    assert one(spark, given, text.action) == expected


def test_similarities(spark):
    row = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], [0.0, 0.0], [])], "a array<double>, b array<double>, z array<double>, e array<double>")
    a, b, z, e = (F.col(x) for x in "abze")
    assert tuple(row.select(vectors.cosine(a, b), vectors.cosine(a, z), vectors.cosine(a, e)).first()) == (1.0, 0.0, 0.0)
    names = spark.createDataFrame([("kefir", "kefir_drink"), ("a_b", "b_c")], "a string, b string")
    assert [r[0] for r in names.select(vectors.name_similarity(F.col("a"), F.col("b"))).collect()] == [0.75, pytest.approx(1 / 3)]


def test_term_patterns_equal_plain_search(spark):
    terms = ("p <", "a.b", "ab", "abc", "x+y", "[z]")
    texts = ["p < 1", "a.b", "axb", "xab", "x+y", "xy", "[z]", "z", ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(text.contains_any(F.col("x"), terms)).collect()]
    assert got == [any(t in x for t in terms) for x in texts]
