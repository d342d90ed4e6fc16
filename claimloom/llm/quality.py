"""Problem 9: per-document text statistics, and whether a document is natural prose, a list, a table or junk.

Method: thresholds on the statistics are noisy labelling functions, each voting for one type of text or abstaining, none looking
at another's statistic. Votes are counted by pattern over all documents; expectation-maximization on their agreements learns, for
every type, its share and how often each function votes under it, and every pattern gets the posterior of the types. Junk and lists
come in types that have little in common (logs, menus, broken characters; bullets, references), so a kind is a set of types and its
posterior their sum. All that is set beforehand is the start and two things that keep the types from changing places: a prior of
``prior`` documents a type, which does not grow with the corpus, and that a function votes for at least nine in ten texts of its own
type. A corpus leaves at most 2 ** functions patterns (524,288 of 19 functions), however large it is; only their counts reach
the driver, documents never do.

Null, empty and blank texts are junk with zero counts and null ratios. Texts of any length are read whole. Rows delivered twice
are judged twice, alike. An empty table yields no row. Ties between kinds go to the first of prose, list, table, junk. Columns
of the input other than the id and the text are ignored, so their names can't clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.session import bounded, written

KINDS = ("prose", "list", "table", "junk")
#: Types of text and the kind each belongs to.
TYPES = {
    "prose": "prose", "bullets": "list", "lines": "list", "references": "list", "inline": "list", "table": "table",
    "blank": "junk", "symbols": "junk", "codes": "junk", "log": "junk", "navigation": "junk", "broken": "junk", "repeated": "junk",
}
#: Function words of ten languages (for scripts without spaces, function characters). Fixed values.
COMMON = frozenset(
    "the of and to in a is was were for on with as by at from that this it be are an or not but had has have we our their which who did does no all some most than between after before during per so why if "
    "der die das und ein eine einen den dem des im mit von zu um bei auf nicht auch wurde wurden war waren ist sich für am als an durch "
    "le la les un une des du de et en est était ont a été au aux dans par pour sur que qui ne pas se chez il ce "
    "el los las una unos del y en se por para con que no es fue al lo su más entre como "
    "и в на с не что по из от до за к у о для при бы был была было были это как но или же он она "
    "में का के की है हैं था थे थी से को ने और पर यह कि लिए तक नहीं बाद "
    "في من على إلى عن أن لم كان كانت هل بعد بين لدى التي الذي هذا".split()
)
_FUNCTION_CHARS = re.compile("[的了在是和与有为对从被吗等也不のをにはがともでたるかすれ]|การ|ที่|และ|ใน|ของ|เป็น|ได้|ไม่|ระหว่าง|ช่วย|หลัง|ทุก|เพิ่มเติม|ยัง|ต้อง|มี|ต่อ|คือ|เข้า|พบ|ลด")
NAVIGATION = frozenset("home menu about contact share subscribe login log cookie cookies settings print next previous skip content search privacy terms sitemap rss back top follow us sign register newsletter read more".split())

_SIGN = "\u0300-\u036f\u0483-\u0487\u064b-\u065f\u0670\u0900-\u0903\u093a-\u094f\u0951-\u0957\u0962\u0963\u0e31\u0e34-\u0e3a\u0e47-\u0e4e"
_SIGNS = re.compile(f"[{_SIGN}]")
_WORD = re.compile(rf"[^\W\d_](?:[^\W\d_]|[{_SIGN}])*(?:['’-][^\W\d_]+)*")
_DIGIT = re.compile(r"\d")
_UPPER = re.compile("[A-ZÀ-ÞА-Я]")
_MARK = re.compile(r"\s*(?:(?:--?|[•*+‣◦▪●·–])\s+|\(?\d{1,3}[.)]\s+|\(?[a-z]{1,2}\)\s+|\[\d{1,3}\]\s+|(?:[ivx]+)[.)]\s+)")
_ENDS = frozenset(".!?…。！？｡।۔؟:")
_AFTER = "\"'”’»)]」』 \t\r\u00a0"
_STOPS = re.compile(r"[.!?。！？｡।۔؟]+[\"'”’»)\]」』]*(?=\s|$|[^\x00-\x7f])")
_CELL = re.compile(r"\s*(?:[-+−]?\d[\d.,]*\s*%?|NA|N/A|n\.?d\.?|-|–|—|nan|null)?\s*$", re.I)
_LOG = re.compile(r"^\s*\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\b(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE|FATAL)\b|^\s*(?:at \w+\.|Traceback |File \")|^\s*[\[{<].*[\]}>],?\s*$")
_REFERENCE = re.compile(r"(?:19|20)\d\d\s*;\s*\d+|\bdoi:|\bet al\.?,? (?:19|20)\d\d|\d+\s*\(\d+\)\s*:\s*\d+|(?:19|20)\d\d\)?[.,;:]? *(?:vol\.? *)?\d+ *: *\d+")
_BROKEN = re.compile("[\u0080-\u009f\ufffd]|[ÂÃÐÑØÙ][^\x00-\x7f]|[ãåäæçèéï][\u0080-\u00bf]|â€")
_MIXED = re.compile(r"(?:(?=.*\d)(?=.*[A-Za-z])[\x21-\x7e]+|[\x21-\x7e]*[|~^][\x21-\x7e]+|[\x21-\x7e]+[|~^%\\][A-Za-z|~^%\\]*)\Z")
_WIDE = "฀-๿぀-ヿ㐀-鿿豈-﫿"
_WIDE_CHAR = re.compile(f"[{_WIDE}]")
_THAI = re.compile("[\u0e00-\u0e7f]")
_GAP = re.compile(r" {2,}")

STATISTICS = (
    "n_chars", "n_words", "n_lines", "mean_word_length", "symbol_ratio", "digit_ratio", "upper_ratio", "terminal_line_share", "common_word_share", "bullet_share", "short_line_share",
    "column_share", "number_cell_share", "reference_share", "log_share", "navigation_share", "mixed_token_share", "broken_share", "distinct_share", "item_words", "n_items", "words_a_stop", "short_items", "repeated_words",
)


def statistics(text: str | None) -> dict[str, float]:
    """Counts and ratios that describe a text. Ratios are of characters, lines or words as their names say; 0 where there is nothing to divide."""
    out = dict.fromkeys(STATISTICS, 0.0)
    if not text or not text.strip():
        out["n_chars"] = float(len(text or ""))
        return out
    lines = [x for x in text.split("\n") if x.strip()]
    dense = sum(map(len, lines)) or 1
    solid = len("".join(text.split())) or 1
    wide, thai = (0, 0) if text.isascii() else (len(_WIDE_CHAR.findall(text)), len(_THAI.findall(text)))
    found = _WORD.findall(_WIDE_CHAR.sub(" ", text) if wide else text)
    n_words = len(found) + (wide - thai) / 2 + thai / 5  # scripts without spaces: the usual length of a word
    plain = text.isascii()
    letters = sum(map(len, found)) - (0 if plain else sum(len(_SIGNS.findall(w)) for w in found if not w.isascii()))
    lower = list(map(str.lower, found))
    common = sum(map(COMMON.__contains__, lower))
    wide_common = len(_FUNCTION_CHARS.findall(text)) if wide else 0
    digits = len(_DIGIT.findall(text))
    tokens = text.split()
    out["n_chars"], out["n_words"], out["n_lines"] = float(len(text)), float(round(n_words)), float(len(lines))
    out["mean_word_length"] = letters / len(found) if found else 0.0
    out["symbol_ratio"] = max(0.0, 1 - (letters + wide + digits + _marks(text)) / solid)
    out["digit_ratio"] = digits / solid
    out["upper_ratio"] = len(_UPPER.findall(text)) / solid
    out["terminal_line_share"] = sum(map(_ended, lines)) / len(lines)
    out["common_word_share"] = (common + wide_common * 1.2) / (n_words or 1)
    stops = len(_STOPS.findall(text))
    out["words_a_stop"] = n_words / stops if stops else 0.0
    marked = [x for x in lines if _MARK.match(x)]
    out["bullet_share"] = sum(map(len, marked)) / dense if len(marked) > 1 else 0.0
    column, cells, numbers = columns(lines)
    out["column_share"], out["number_cell_share"] = column / dense, numbers / cells if cells else 0.0
    out["short_line_share"] = sum(len(x) for x in lines if _width(x) <= 48 and len(x.split()) <= 8 and not _ended(x)) / dense if len(lines) > 2 else 0.0
    out["reference_share"] = sum(len(x) for x in lines if _REFERENCE.search(x)) / dense if digits > 4 else 0.0
    out["log_share"] = sum(len(x) for x in lines if _LOG.search(x)) / dense
    out["navigation_share"] = sum(map(NAVIGATION.__contains__, lower)) / len(lower) if lower else 0.0
    out["mixed_token_share"] = sum(map(_mixed, tokens)) / len(tokens)
    out["broken_share"] = 0.0 if plain else len(_BROKEN.findall(text)) / solid
    units = lower if len(lower) >= wide / 4 else re.findall(r"[^\s。！？、，；]{2,}", text)
    out["distinct_share"] = len(set(units)) / len(units) if units else 0.0
    items = [x for x in re.split(r"[,;、，；|]|>>|»\s|\s[·•/]\s", lines[0] if len(lines) == 1 else text) if x.strip()]
    out["n_items"] = float(len(items))
    out["item_words"] = n_words / len(items) if items else 0.0
    out["short_items"] = float(len(items)) if out["item_words"] <= 5 and not stops else 0.0  # separated items that no sentence ends in
    out["repeated_words"] = float(round(n_words)) if out["distinct_share"] < 0.15 and n_words * out["distinct_share"] <= 14 else 0.0  # words that are the same few
    return out


def _mixed(token: str) -> bool:
    """A token of letters with digits or odd symbols in it."""
    return not token.isalpha() and _MIXED.match(token) is not None


def _ended(line: str) -> bool:
    """Does a line end like a sentence?"""
    bare = line.rstrip(_AFTER)
    return bool(bare) and bare[-1] in _ENDS


def _width(x: str) -> int:
    return len(x) + len(_WIDE_CHAR.findall(x)) if not x.isascii() else len(x)


def _marks(text: str) -> int:
    """Combining signs, which are parts of letters."""
    return 0 if text.isascii() else len(_SIGNS.findall(_THAI.sub("", text)))


def columns(lines: list[str]) -> tuple[int, int, int]:
    """Characters in runs of at least three lines with the same number of columns; the cells in them, and those that hold a number or nothing."""
    best = (0, 0, 0)
    for d in ("\t", "|", ";", ",", "&", "  "):
        bare = [x.strip().strip("|").rstrip(";, \\") if d != "\t" else x for x in lines]
        counts = [len(_GAP.findall(x)) if d == "  " else x.count(d) for x in bare]
        chars = cells = numbers = 0
        i, n = 0, len(lines)
        while i < n:
            j = i
            while j < n and counts[j] == counts[i]:
                j += 1
            if counts[i] >= 1 and j - i >= 3 or counts[i] >= 2 and j - i >= 2:
                run_cells = run_numbers = 0
                for x in bare[i:j]:
                    parts = _GAP.split(x) if d == "  " else x.split(d)
                    run_cells += len(parts)
                    run_numbers += sum(_CELL.match(p) is not None for p in parts)
                if run_numbers >= 0.25 * run_cells:
                    chars += sum(map(len, lines[i:j]))
                    cells += run_cells
                    numbers += run_numbers
            i = j
        if chars > best[0]:
            best = (chars, cells, numbers)
    return best


#: Labelling functions: name, the type they vote for, and the threshold that makes them vote.
FUNCTIONS: tuple[tuple[str, str, Callable[[dict[str, float]], bool]], ...] = (
    ("common_words", "prose", lambda s: s["common_word_share"] >= 0.15),
    ("sentence_lines", "prose", lambda s: s["terminal_line_share"] >= 0.5),
    ("sentence_lengths", "prose", lambda s: 2 <= s["words_a_stop"] <= 45),
    ("long_items", "prose", lambda s: s["item_words"] >= 6),
    ("varied_words", "prose", lambda s: s["distinct_share"] >= 0.3),
    ("bullets", "bullets", lambda s: s["bullet_share"] >= 0.5),
    ("short_lines", "lines", lambda s: s["short_line_share"] >= 0.5),
    ("references", "references", lambda s: s["reference_share"] >= 0.5),
    ("short_items", "inline", lambda s: s["short_items"] >= 4),
    ("columns", "table", lambda s: s["column_share"] >= 0.5),
    ("digits", "table", lambda s: s["digit_ratio"] >= 0.12),
    ("no_words", "blank", lambda s: s["n_words"] < 1),
    ("symbols", "symbols", lambda s: s["symbol_ratio"] >= 0.45),
    ("mixed_tokens", "codes", lambda s: s["mixed_token_share"] >= 0.3),
    ("machine_lines", "log", lambda s: s["log_share"] >= 0.5),
    ("navigation", "navigation", lambda s: s["navigation_share"] >= 0.2),
    ("menu", "navigation", lambda s: s["navigation_share"] >= 0.35),
    ("broken_characters", "broken", lambda s: s["broken_share"] >= 0.03),
    ("repetition", "repeated", lambda s: s["repeated_words"] >= 12),
)


def votes(s: dict[str, float]) -> int:
    """The functions that vote, as bits."""
    return sum(1 << i for i, (_, _, f) in enumerate(FUNCTIONS) if f(s))


@dataclass
class Learnt:
    """What expectation-maximization has learnt: the share of each type, how often each function votes under it, and each pattern's posterior of the types."""

    share: np.ndarray
    rate: np.ndarray
    types: dict[int, np.ndarray]

    def kinds(self, pattern: int) -> np.ndarray:
        return self.types[pattern] @ _KIND_OF


_KIND_OF = np.array([[kind == k for k in KINDS] for kind in TYPES.values()], float)


def learn(patterns: dict[int, int], *, rounds: int = 60, prior: float = 20.0, start: tuple[float, float] = (0.9, 0.05), least: float = 0.9) -> Learnt:
    """Expectation-maximization over vote patterns. ``start`` is how often a function votes under its own type and under another one, ``prior`` the documents a type that this counts for, ``least`` how often a function votes under its own type at least."""
    m, k = len(FUNCTIONS), len(TYPES)
    own = np.array([list(TYPES).index(t) for _, t, _ in FUNCTIONS])[:, None] == np.arange(k)[None]
    before = np.where(own, *start)
    codes = sorted(patterns)
    n = np.array([patterns[c] for c in codes], float)
    v = (np.array(codes, "i8").reshape(-1, 1) >> np.arange(m)[None] & 1).astype(float)
    rate, share = before, np.full(k, 1 / k)
    post = np.zeros((len(codes), k))
    for _ in range(rounds if len(codes) else 0):
        log = np.log(share)[None] + v @ np.log(rate) + (1 - v) @ np.log(1 - rate)
        post = np.exp(log - log.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        mass = (post * n[:, None]).sum(0)
        share = (mass + 1) / (mass + 1).sum()
        rate = np.clip((v.T @ (post * n[:, None]) + prior * before) / (mass + prior)[None], 1e-4, 1 - 1e-4)
        rate = np.where(own, np.maximum(rate, least), rate)
    return Learnt(share, rate, dict(zip(codes, post, strict=True)))


SCHEMA = "doc_id bigint, votes bigint, " + ", ".join(f"{s} double" for s in STATISTICS)


def measured(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, the votes as bits, and all statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [statistics(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([votes(x) for x in s], pa.int64()), *(pa.array([x[k] for x in s], pa.float64()) for k in STATISTICS)],
                names=["doc_id", "votes", *STATISTICS],
            )

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def _patterns(m: DataFrame) -> dict[int, int]:
    return {r["votes"]: r["count"] for r in bounded(m.groupBy("votes").count(), 1 << len(FUNCTIONS), "vote patterns")}  # which can't be more


def judged(docs: DataFrame, *, keep: tuple[str, ...] = STATISTICS, **how: str) -> DataFrame:
    """``doc_id``, statistics, ``kind`` and the posterior of every kind."""
    m = written(measured(docs, **how).select("doc_id", "votes", *keep), "text-statistics")
    learnt = learn(_patterns(m))
    kinds = {c: learnt.kinds(c) for c in learnt.types}
    table = [(c, KINDS[int(np.round(p, 12).argmax())], *map(float, p)) for c, p in kinds.items()]
    known = docs.sparkSession.createDataFrame(table, "votes bigint, kind string, " + ", ".join(f"p_{k} double" for k in KINDS))
    return m.join(F.broadcast(known), "votes").drop("votes")  # at most 2 ** functions rows


def found(docs: DataFrame) -> DataFrame:
    """Documents that are mostly not natural prose."""
    return judged(docs, keep=()).where("kind <> 'prose'").select("doc_id", "kind")


def accuracies(docs: DataFrame) -> DataFrame:
    """For each labelling function: its type and kind, how often it votes, and how often a text it votes for is of its kind, as learnt."""
    patterns = _patterns(measured(docs))
    learnt = learn(patterns)
    total = sum(patterns.values()) or 1
    out = []
    for i, (name, of, _) in enumerate(FUNCTIONS):
        hit = [(n, learnt.kinds(c)) for c, n in patterns.items() if c >> i & 1]
        cast = sum(n for n, _ in hit)
        out.append((name, of, TYPES[of], cast / total, sum(n * float(p[KINDS.index(TYPES[of])]) for n, p in hit) / cast if cast else None))
    return docs.sparkSession.createDataFrame(out, "function string, text_type string, kind string, coverage double, accuracy double")
