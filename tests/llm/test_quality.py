"""Statistics of texts, what the functions learn, and odd documents."""

import pytest

from claimloom.llm import quality as Q

PROSE = ["The cat sat on the mat and looked at the dog. It was late in the day.", "Der Hund lag auf dem Boden und war nicht müde. Die Katze kam am Abend.", "两组的腰围没有差异。结果令人意外！", "क्या इडली सचमुच रक्तचाप बदलता है? कुल 18 लोगों को देखा गया।", "in this trial the dose was given to the men in the morning and it did not change the weight of those who took it"]
LISTS = ["- kefir\n- milk\n- tea\n- soy", "a) kefir;\nb) tea;\nc) miso;", "kefir, soy milk, black tea, natto, miso, tempeh", "1. kefir\n2. tea\n3. rice\n4. miso", "Items:\nkefir\nnatto\nmiso\ntea\nrice"]
TABLES = ["id\tfood\tn\n1\tkefir\t3\n2\ttea\t4\n3\tmiso\t9", "| id | food | n |\n| 1 | tea | 3.5 |\n| 2 | soy | 7 |\n| 3 | rice | NA |", "1  kefir   4.5   7\n2  tea     8.1   9\n3  miso    2     1"]
JUNK = ["", None, " \n ", "#########\n~~~~~~~~~~ \n=======", "Home | About | Share | Log in | Menu | Contact | Subscribe", "cheap kefir " * 30, "a1b2c3d4e5f60718293a4b5c6d7e8f90" * 2 + "\n" + "0f9e8d7c6b5a4f3e2d1c0b9a8f7e6d5c" * 2, "2024-04-02T01:00:43Z INFO extractor[5770]: timeout pmid=4804646 t=0.435s\n2024-04-02T01:00:44Z WARN extractor[5771]: retry pmid=4804647 t=0.4s"]


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(i, t) for i, t in enumerate(PROSE * 12 + LISTS * 2 + TABLES * 2 + JUNK * 2)]
    return rows, {r["doc_id"]: r for r in Q.judged(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}


def test_kinds(judged):
    rows, got = judged
    want = {i: "prose" if t in PROSE else "list" if t in LISTS else "table" if t in TABLES else "junk" for i, t in rows}
    wrong = [(rows[i][1], got[i]["kind"]) for i in want if got[i]["kind"] != want[i]]
    assert not wrong


def test_posteriors_sum_to_one(judged):
    for r in judged[1].values():
        assert sum(r[f"p_{k}"] for k in Q.KINDS) == pytest.approx(1)


def test_statistics():
    s = Q.statistics("One two, three.\nfour!")
    assert (s["n_words"], s["n_lines"], s["terminal_line_share"], s["n_chars"]) == (4, 2, 1.0, 21)
    assert s["mean_word_length"] == pytest.approx(15 / 4)
    assert Q.statistics("1,2,3\n4,5,6\n7,8,9")["column_share"] == 1.0
    assert all(v == 0 for k, v in Q.statistics(None).items())
    assert Q.statistics("word " * 200_000)["n_words"] == 200_000


def test_found_and_empty(spark):
    df = spark.createDataFrame([(1, "- a\n- b\n- c", 9), (1, "- a\n- b\n- c", 9), (2, None, 9)], "doc_id bigint, text string, kind int")
    assert {r["doc_id"] for r in Q.found(df).collect()} == {1, 2} and Q.found(df).count() == 3
    assert Q.found(df.limit(0)).count() == 0 and Q.judged(df.limit(0)).count() == 0


def test_learning_keeps_functions_on_their_own_side():
    bit = {name: 1 << i for i, (name, _, _) in enumerate(Q.FUNCTIONS)}
    prose, bullets, log = bit["common_words"] | bit["sentence_lines"] | bit["varied_words"], bit["bullets"] | bit["varied_words"], bit["machine_lines"] | bit["digits"]
    got = Q.learn({prose: 900, bullets: 50, log: 50})
    own = [list(Q.TYPES).index(t) for _, t, _ in Q.FUNCTIONS]
    assert all(got.rate[i, k] <= got.rate[i, own[i]] + 0.1 for i in range(len(own)) for k in range(len(Q.TYPES)) if i != [*bit].index("varied_words"))
    assert [Q.KINDS[got.kinds(c).argmax()] for c in (prose, bullets, log)] == ["prose", "list", "junk"]
    assert got.share.sum() == pytest.approx(1) and Q.learn({}).types == {}


def test_rates_are_learnt_and_not_set():
    """What a function does under other types than its own comes from the documents."""
    bit = {name: 1 << i for i, (name, _, _) in enumerate(Q.FUNCTIONS)}
    reference = bit["references"] | bit["digits"] | bit["sentence_lengths"]
    prose = bit["common_words"] | bit["sentence_lengths"] | bit["sentence_lines"]
    got = Q.learn({prose: 5000, reference: 400, bit["columns"] | bit["digits"]: 400})
    at = list(Q.TYPES).index("references")
    rate = {name: got.rate[i, at] for i, (name, _, _) in enumerate(Q.FUNCTIONS)}
    assert rate["digits"] > 0.9 and rate["sentence_lengths"] > 0.9 and rate["common_words"] < 0.1
    assert Q.KINDS[got.kinds(reference).argmax()] == "list"


def test_each_function_looks_at_its_own_threshold():
    """Functions disagree: none is switched off by what another one sees."""
    s = dict.fromkeys(Q.STATISTICS, 0.0) | {"common_word_share": 0.4, "n_words": 50.0, "bullet_share": 0.9, "column_share": 0.9, "navigation_share": 0.5}
    names = {name for i, (name, _, _) in enumerate(Q.FUNCTIONS) if Q.votes(s) >> i & 1}
    assert {"common_words", "bullets", "columns", "navigation", "menu"} <= names
