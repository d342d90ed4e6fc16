"""Sentence units in several scripts, offsets, layouts, and evidence from documents and the corpus."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimloom.llm import sentences as S


def split(text, *more):
    stop, start = S.count_words(iter([text, *more]))
    rows = [("stop", w, *n) for w, n in stop.items()] + [("start", w, *n) for w, n in start.items()]
    return [text[a:b] for a, b in S.Splitter(S.Lexicon(iter(rows)))(text)]


@pytest.mark.parametrize(
    "parts",
    [
        ["Dr. Marandeth read Fig. 3 and Eq. 5 of ref. 18.", "The dose was 4.5 mg."],
        ["It was kept at 9.5 °C.", "We enrolled 13 adults."],
        ['"Is it worth the effort?" asked one reviewer.', 'The panel noted that "the dose was too low."', "It ended."],
        ["The drink sold as Zest! was not tested.", "Results were mixed ... yet most improved.", "More work is under way...", "It ended."],
        ["(Two arms were pooled.)", "So why did it rise?!", "It did."],
        ["Frau Dr. Tovarisk prüfte alles.", "Das Gremium schrieb: „Die Dosis war zu gering.“", "Ein Ende."],
        ["« Est-ce utile ? » demande un relecteur.", "Quel résultat pour le LDL !", "Le Dr Abelindo a mesuré."],
        ["«¿Vale la pena?», preguntó un revisor.", "¡El efecto fue notable!", "¿Cambia algo?", "En EE. UU. pocos lo consumen."],
        ["«Стоит ли это усилий?» — спросил рецензент.", "Проф. А. В. Иванов проверил записи (см. рис. 5).", "Конец."],
        ["क्या इडली सचमुच रक्तचाप बदलता है?", "डॉ. Tovarisk ने आँकड़े जाँचे।", "मात्रा 120 ग्रा. प्रतिदिन थी।"],
        ["هل يغير الكفير ضغط الدم؟", "راجع د. Marandeth جميع السجلات.", "زال التأثير!"],
        ["ขนาดที่ใช้คือ 200 กรัมต่อวัน", "ผลต่อรอบเอวลดลง 5.9 หน่วยหลังสิ้นสุดการทดลอง"],
    ],
)
def test_spaced_scripts(parts):
    assert split(" ".join(parts)) == parts


@pytest.mark.parametrize("parts", [["评审组写道：“剂量太低。”", "食物包括面包、米饭……但不含酒精。", "“值得吗？”一位审稿人问道。", "与L. plantarum相关的变化见图4.1。"], ["「効果は小さい。」と委員会は述べた。", "委員の一人は「用量が低い。」", "対象は13名で、24週間追跡した。", "予想外であった！"]])
def test_scripts_without_spaces(parts):
    assert split("".join(parts)) == parts


def test_layouts():
    assert split("- One. Two\n- Three") == ["- One. Two", "- Three"]
    assert split("One line\ngoes on.\nNext one.\n\nno mark here\n\n  End  ") == ["One line\ngoes on.", "Next one.", "no mark here", "End"]
    assert split("BACKGROUND: It was sp. OBJECTIVE: To see. RESULTS: None.") == ["BACKGROUND: It was sp.", "OBJECTIVE: To see.", "RESULTS: None."]


def test_the_document_and_the_corpus_decide():
    # "Orlan" is a name elsewhere in the text, "In" an ordinary word
    assert split("We read St. Orlan notes in time. Supplied by Fermavita Inc. In men, it fell. Then Orlan and Fermavita Inc. had gone.")[:2] == ["We read St. Orlan notes in time.", "Supplied by Fermavita Inc."]
    alone = "It was given by Xyz. Bcd knew."
    assert len(split(alone)) == 2
    assert len(split(alone, "the Xyz. small one, Xyz. a, Xyz, we saw Bcd and Bcd, like Bcd")) == 1


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB .!?\n\"'()。」“”…-5อ क। Dr"), max_size=60))
def test_nothing_but_white_space_is_lost(text):
    at = 0
    for a, b in S.Splitter()(text):
        assert a >= at and b > a and not text[at:a].strip() and text[a:b] == text[a:b].strip()
        at = b
    assert not text[at:].strip()


def test_tables(spark):
    full = spark.createDataFrame([(1, "One. Two.", 5), (2, None, 5), (3, "", 5), (4, " \n ", 5)], "fulltext_id bigint, abstract string, text int")
    claims = spark.createDataFrame([(1, "Dr. Who 😀 came. Yes."), (1, "Dr. Who 😀 came. Yes."), (2, "x" * 300_000)], "claim_row_id bigint, evidence_snippet string")
    got = sorted(tuple(r) for r in S.found(full, claims).collect())
    assert got == [("extracted_claims", 1, 0, 15), ("extracted_claims", 1, 0, 15), ("extracted_claims", 1, 16, 20), ("extracted_claims", 1, 16, 20), ("extracted_claims", 2, 0, 300_000), ("full_text", 1, 0, 4), ("full_text", 1, 5, 9)]
    assert S.found(full.limit(0), claims.limit(0)).count() == 0


def test_a_lexicon_of_any_size_gives_the_same(spark):
    full = spark.createDataFrame([(i, f"Dr. Who read vol. {i} of Inc. In time Fermavita Inc. had gone. The U.S. cohort came from the U.S. We left.") for i in range(30)], "fulltext_id bigint, abstract string")
    claims = spark.createDataFrame([(1, "In the U.S. men of Fermavita Inc. slept.")], "claim_row_id bigint, evidence_snippet string")
    a = sorted(map(tuple, S.found(full, claims).collect()))
    b = sorted(map(tuple, S.found(full, claims, most_lexicon=0).collect()))
    assert a == b and len(a) > 60


@pytest.mark.parametrize("size", [1, 3, 100])
def test_batches_do_not_change_the_counts(spark, size):
    texts = ["It fell in women. Lactis was given."] * 9 + ["Most women. had it. We saw Lactis and women, lactis too."] + ["It was ca. Lactis, not lactis."] * 3
    stop, start = S.count_words(iter(texts))
    want = {("stop", w, *n) for w, n in stop.items() if n[0] + n[1] + n[2]} | {("start", w, *n) for w, n in start.items() if w != w.lower() and n[3]}
    assert stop["women"] == [1, 0, 0, 9] and ("start", "Lactis", *start["Lactis"]) in want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = {tuple(r) for r in S.corpus_counts(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


HARD = ["It was vs. IL-6 there. End", "As approx. L’étude was read. End", "Seen in cf. Omega-3 users. End", "Run at °Xq. Bcd. “Then” so. (*Xq. Bcd-Efg) was; Xq. «Bcd» too."]
EVIDENCE = ["the vs. small, vs. a, approx. no, cf. it, cf. we, approx. 5, Xq. a, Xq. no, *Xq. so we saw IL and IL, L’étude and L’étude, saw Omega and Omega, like Bcd and Bcd-Efg. Is ca. IL. Is ca. L’étude. Is ca. Omega. Is ca. Bcd."] * 6


class Asked(dict):
    def __init__(self, of, seen, kind):
        super().__init__(of)
        self.seen, self.kind = seen, kind

    def get(self, w, default=None):
        self.seen.add((self.kind, w))
        return super().get(w, default)

    def __contains__(self, w):
        self.seen.add((self.kind, w))
        return super().__contains__(w)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.sampled_from(HARD), st.text(alphabet=st.sampled_from("aBX .!?\n\"'(),“”«»’-5°*é"), max_size=60)), st.booleans())
def test_lookups_hold_all_that_is_asked(text, known):
    seen = set()
    lex = S.Lexicon()
    every = S.Splitter.lookups(text)
    lex.stop = Asked({w: (5, 5, 5, 0) for k, w in every if k == "stop" and known}, seen, "stop")
    lex.start = Asked({w: (0, 9, 0, 9) for k, w in every if k == "start" and known}, seen, "start")
    S.Splitter(lex)(text)
    assert seen <= every


def test_a_joined_lexicon_knows_words_with_hyphens_and_apostrophes(spark):
    full = spark.createDataFrame(list(enumerate(HARD + EVIDENCE)), "fulltext_id bigint, abstract string")
    claims = spark.createDataFrame([], "claim_row_id bigint, evidence_snippet string")
    a = sorted(map(tuple, S.found(full, claims).collect()))
    assert a == sorted(map(tuple, S.found(full, claims, most_lexicon=0).collect()))
    assert [r[2:] for r in a if r[1] < 3] == [(0, len(t) - 4) if i == 0 else (len(t) - 3, len(t)) for t in HARD[:3] for i in range(2)]


def test_time_grows_with_the_length():
    """Texts of megabytes, with abbreviations, quotations, numbers, and without spaces."""
    import time

    prose = "Probiotics, e.g. L. casei, improved digestion approx. 3 days later. The 2. Gruppe und die \"Kontrolle.\" Yes. Vgl. Abb. 3 of Nr. 5 here. "
    for text in (prose * 40_000, "a." * 1_000_000, "a-" * 1_000_000 + ". B", '"a." ' * 400_000, "x" * 3_000_000 + ". B", ". " * 800_000):
        began = time.perf_counter()
        parts_ = S.Splitter()(text)
        S.count_words([text])
        S.Splitter.lookups(text)
        assert parts_ and time.perf_counter() - began < 30


def test_words_of_any_length_can_be_abbreviations():
    word = "Elektroenzephalographiegerätekunde" * 2  # beyond 40 letters, and beyond 12
    stop, _ = S.count_words([f"Die {word}. und andere, die {word}. und so."])
    assert stop[word] == [2, 0, 0, 0]
    known = S.Splitter(S.Lexicon([("stop", word, 9, 0, 0, 1), ("start", "Nord", 0, 9, 0, 1)]))
    assert len(known(f"Die {word}. Nord war da.")) == 1
