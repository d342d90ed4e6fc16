"""Mapping typed values: known cases, brute force over the whole list, and odd inputs."""

import random

import pytest

from claimloom.llm import canonical as C

LIST = [
    (1, "yogurt", ["dahi"]), (2, "goat milk yogurt", []), (3, "miso", []), (4, "barley miso", []), (5, "LDL cholesterol", ["LDL-C"]), (6, "HDL cholesterol", []), (7, "interleukin 6", ["IL-6"]), (8, "interleukin 10", ["IL-10"]),
    (9, "Lacticaseibacillus paracasei FR-548", ["Lactobacillus paracasei FR-548"]), (10, "Lacticaseibacillus paracasei FR-845", ["Lactobacillus paracasei FR-845"]), (11, "energy intake", None), (12, "total cholesterol", ["TC"]), (13, "kefir", []), (14, "unpasteurized sauerkraut", []), (15, "pasteurized sauerkraut", []),
    (16, "tumor necrosis factor alpha", ["TNF-α"]),
]


@pytest.fixture(scope="module")
def match():
    return C.Matcher(C.Dictionary.build(LIST))


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("Yoghourt ", 1), ("DAHI", 1), ("yogurt, goat milk", 2), ("GOAT_MILK_YOGHURT (plain)", 2), ("bralye miso", 4), ("mios", 3), ("LDL cholesterol levels", 5), ("hdl-cholesterol, mean", 6), ("IL 6", 7), ("interleukin-10 at follow-up", 8), ("interleukn 10", 8),
        ("L. paracasei FR548", 9), ("l._paracasri_strain_fr-845", 10), ("Lacticaseibacillus paracasei FR-854", 0), ("LacticaseibacillusparacaseiFR548 ;", 9), ("Energy intake", 11), ("TC", 12), ("TD", 0), ("kéfir", 13), ("kephir", 13), ("Sauerkraut (Unpasteurized)", 14), ("kef​ir", 13),
        ("puffed lentils", 0), ("placebo", 0), ("-", 0), ("", 0), ("x " * 20_000, 0), ("y" * 50_000, 0), ("ldlcholesterolconcentration", 5), ("tnf-Α", 16), ("kefir intake consumption", 13),
    ],
)
def test_known_values(match, value, expected):
    assert match(value)[0] == expected


def edits(a, b):
    d = {}
    for i in range(-1, len(a) + 1):
        d[i, -1] = i + 1
    for j in range(-1, len(b) + 1):
        d[-1, j] = j + 1
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_near_words_equal_brute_force(match):
    """Every word of the list within the bound is found through its deletes."""
    random.seed(1)
    words = sorted(w for w in match.d.vocabulary if w.isalpha())
    for w in random.sample(words, 12):
        for _ in range(40):
            x = list(w)
            for _ in range(random.randint(0, 2)):
                i, op = random.randrange(len(x)), random.randrange(3)
                if op == 0 and len(x) > 3:
                    del x[i]
                elif op == 1:
                    x.insert(i, random.choice("abcxyz"))
                else:
                    x[i] = random.choice("abcxyz")
            x = "".join(x)
            found = dict(match.d.near(x))
            for v in words:
                if C.weighted_distance(x, v, min(C.word_bound(len(x)), C.word_bound(len(v)))) <= min(C.word_bound(len(x)), C.word_bound(len(v))):
                    assert v in found


def test_weighted_distance_is_bounded_by_plain_edits():
    random.seed(2)
    for _ in range(300):
        a, b = ("".join(random.choices("abcde", k=random.randint(1, 8))) for _ in range(2))
        d = C.weighted_distance(a, b, 99)
        assert d <= edits(a, b) + 1e-9 and (d == 0) == (a == b)
    assert C.weighted_distance("fr548", "fr845", 9) == float("inf")


def test_tables(spark):
    ref = spark.createDataFrame(LIST, "canonical_id int, canonical_name string, known_aliases array<string>")
    claims = spark.createDataFrame([(1, "yogurt", "LDL cholesterol level"), (2, None, "  "), (3, "Yogurt", "grip angle"), (3, "Yogurt", "grip angle")], "claim_row_id bigint, subject_name string, object_name string")
    ents = spark.createDataFrame([(7, [None, "", "dahi", "kefri"]), (8, None), (9, [])], "entity_id bigint, aliases array<string>")
    got = sorted(tuple(r) for r in C.found(claims, ents, ref).collect())
    assert got == [(1, "object_name", 0, 5), (3, "object_name", 0, 0), (3, "object_name", 0, 0), (3, "subject_name", 0, 1), (3, "subject_name", 0, 1), (7, "aliases", 2, 1), (7, "aliases", 3, 13)]
    missed = {(r["value"], r["field"]): r["n"] for r in C.misses(claims, ents, ref).collect()}
    assert missed == {("grip angle", "object_name"): 2}
    assert C.found(claims.limit(0), ents.limit(0), ref).count() == 0
    assert {r["canonical_id"] for r in C.found(claims, ents, ref.limit(0)).collect()} == {0}


def test_pieces_of_a_large_list_give_the_same(spark):
    ref = spark.createDataFrame(LIST, "canonical_id int, canonical_name string, known_aliases array<string>")
    v = spark.createDataFrame([(x, 1) for x in ("yoghurt", "hdl cholestrol", "il-10", "nothing", "sauerkraut pasteurized", None)], "value string, distance int")
    a = {r["value"]: r["canonical_id"] for r in C.map_values(v, ref).collect()}
    b = {r["value"]: r["canonical_id"] for r in C.map_values(v, ref, most_names=9).collect()}
    assert a == b and a["hdl cholestrol"] == 6 and a[None] == 0


def test_frequency_breaks_ties(spark):
    d = C.Dictionary.build([(1, "fat mass", []), (2, "fas mass", [])], {2: 5})
    assert C.Matcher(d)("faz mass")[0] == 2
    assert C.Matcher(C.Dictionary.build([(1, "fat mass", []), (2, "fas mass", [])]))("faz mass")[0] == 1


def test_noise_is_cut_as_often_as_it_is_there(match):
    assert match("kefir" + " intake" * 50)[0] == 13
    assert match("kefir" + "intake" * 50)[0] == 13
    assert match("kefir" + " intake" * 300_000)[0] == 13  # in time linear in the length
    assert C.Matcher(match.d, noise=("dose",))("kefir dose dose")[0] == 13
    assert C.Matcher(match.d, noise=())("kefir consumption")[0] == 0


def test_a_list_longer_than_a_dictionary(spark):
    """One name more than a dictionary holds: the answers do not depend on the division."""
    random.seed(3)
    names = sorted({"".join(random.choices("aeioubcdlmnrst", k=9)) for _ in range(C.MOST_NAMES + 50)})[: C.MOST_NAMES + 1]
    assert len(names) == C.MOST_NAMES + 1
    ref = spark.createDataFrame([(i + 1, n, None) for i, n in enumerate(names)], "canonical_id int, canonical_name string, known_aliases array<string>")
    asked = [n[:4] + "x" + n[5:] for n in names[::50]] + names[1::50]
    df = spark.createDataFrame([(x,) for x in asked], "value string")
    a = {r["value"]: r["canonical_id"] for r in C.map_values(df, ref).collect()}
    whole = C.Matcher(C.Dictionary.build((i + 1, n, None) for i, n in enumerate(names)))
    assert a == {x: whole(x)[0] for x in asked} and all(a.values())
