"""Problem 3: sentence boundaries across languages and scripts.

Method: document-centred disambiguation. Whether the word before a period is an abbreviation, and whether the capitalised word
after it is a name or an ordinary word that starts a sentence, is decided from the unambiguous occurrences of both elsewhere in
the same document; where the document has none, from counts over the whole corpus; where the corpus has none, from the shape.
Scripts have their own terminators: ideographic and Devanagari full stops end sentences without a following space, a period does
not end one in Devanagari, and Thai, which has no terminators, is divided at spaces that do not touch a number.

Lines that open with a bullet are one sentence each; other line breaks are white space, blank lines end sentences. Closing
quotes and brackets go with the sentence they close. A quotation that is carried on (by a small letter, a dash, a comma or, in
scripts without capitals, where it opened its sentence) ends nothing.

Texts that are null, empty or blank yield no row; texts of any length are read whole. Rows delivered twice yield their sentences
twice. Offsets count code points from 0, the end is exclusive. Extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.session import bounded, written

FULL = "。！？｡"
UNCASED_STOP = "।॥۔؟"
CLOSERS = "\"'”’»›)]}」』）】》〉］“"
QUOTES = "\"'”’»›「」『』《》“„‚«‹‘"
OPENERS = "\"'“‘«‹([{„‚「『（【《〈［¿¡"
BULLETS = "-•*+‣◦▪●○■□➢➤✓"
#: Titles, which names follow, and words that numbers follow, for words the corpus says nothing about. Fixed values.
TITLES = frozenset("dr prof mr mrs ms st sr sra srta dra mme mlle hr frl dipl ing проф акад доц им".split())
NUMBERED = frozenset("no nos nr fig figs eq eqs ref refs pp vol sec tab abb art núm num pág cap ex suppl рис табл стр гл ca approx max min env aprox vgl ок".split())
MOST_LEXICON = 200_000
#: Words a task counts before it hands them on.
MOST_TABLE = 300_000

_TERM = re.compile(r"[.!?…।॥۔؟。！？｡‼⁇⁈⁉]+")
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_BLANK = re.compile(r"\n[ \t\r\f\v  ​]*\n\s*")
_MARKER = re.compile(rf"[ \t]*(?:[{re.escape(BULLETS)}][ \t]+(?=\S))")
_NUMBERED = re.compile(r"[ \t]*(?:\(?\d{1,3}[.)]|\(?[a-zA-Z]\)|\[\d{1,3}\])[ \t]+(?=\S)")
_THAI_SPACE = re.compile(r"(?<=[฀-๏])\s+(?=[฀-๏])")
_THAI = re.compile(r"[฀-๏]")
_GERMAN = re.compile(r"\b(?:und|der|die|das|ein|eine|wurde|wurden|nicht|für|bei|mit|von|um|am)\b")


@lru_cache(4096)
def _cased(c: str) -> bool:
    return c.lower() != c.upper()


@lru_cache(4096)
def _is_ideograph(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "豈" <= c <= "﫿"


@lru_cache(4096)
def _devanagari(c: str) -> bool:
    return "ऀ" <= c <= "෿"


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """Stretches between blank lines, bulleted lines on their own: start, end, bulleted."""
    at = 0
    for m in (*_BLANK.finditer(text), None):
        end = m.start() if m else len(text)
        if end > at:
            yield from _lines(text, at, end)
        at = m.end() if m else end


def _lines(text: str, s: int, e: int) -> Iterator[tuple[int, int, bool]]:
    if "\n" not in text[s:e]:
        yield s, e, bool(_MARKER.match(text, s, e) or False)
        return
    starts = [s]
    at = text.find("\n", s, e)
    while at >= 0:
        starts.append(at + 1)
        at = text.find("\n", at + 1, e)
    ends = [*(x - 1 for x in starts[1:]), e]
    numbered = all(_NUMBERED.match(text, a, b) for a, b in zip(starts, ends, strict=True))
    open_at, bulleted = s, False
    for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
        mark = numbered or _MARKER.match(text, a, b)
        if mark:
            if a > open_at:
                yield open_at, a, bulleted
            open_at, bulleted = a, True
        elif bulleted and i and b > a and not (text[a].isspace() or text[a].islower()):
            yield open_at, a, True
            open_at, bulleted = a, False
    yield open_at, e, bulleted


def _before(text: str, at: int, low: int) -> str:
    """The word that ends at a position, with the periods inside it. A period with a word after it ends none, so a stretch without space is read once."""
    i = at
    while i > low:
        c = text[i - 1]
        if c.isspace() or c in "\"“”«»()[]{},;:!?‘’/=<>":
            break
        i -= 1
    return text[i:at]


def _bare(w: str) -> str:
    """The word without the marks it may open with."""
    return w.lstrip("-–—'*_°")


def _number(w: str) -> bool:
    return bool(w) and w[-1].isdigit() and w[0] in "0123456789+-−–.#"


class Lexicon:
    """Corpus counts: for words before a period what follows them, for words after one where else they stand."""

    def __init__(self, rows: Iterator[tuple[str, str, int, int, int, int]] = ()) -> None:
        self.stop: dict[str, tuple[int, int, int, int]] = {}
        self.start: dict[str, tuple[int, int, int, int]] = {}
        for kind, word, a, b, c, d in rows:
            (self.stop if kind == "stop" else self.start)[word] = (a, b, c, d)


class Document:
    """What a document itself says of its words and marks, each indexed once and only if asked for, so a text takes time in proportion to its length."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.german: dict[tuple[int, int], bool] = {}

    @cached_property
    def stops(self) -> dict[str, list[int]]:
        """Of each word before a period: how often it is met, how often it goes on (small letter or comma), how often the text ends."""
        out: dict[str, list[int]] = {}
        for m in _LAST.finditer(self.text):
            n = out.setdefault(_bare(m[1]), [0, 0, 0])
            kind = _follows(self.text, m.end())
            n[0] += 1
            n[1] += kind in ("lower", "comma")
            n[2] += kind == "end"
        return out

    @cached_property
    def within(self) -> set[str]:
        """Words between a space and a space or comma."""
        return set(_SPACED.findall(self.text))

    @cached_property
    def marks(self) -> dict[str, list[int]]:
        """Where quotation marks stand that may open or close."""
        out: dict[str, list[int]] = {"„": [], "“": [], '"': []}
        for m in _QUOTE.finditer(self.text):
            out[m[0]].append(m.start())
        return out

    def last(self, mark: str, low: int, high: int) -> int:
        at = self.marks[mark]
        i = bisect_left(at, high)
        return at[i - 1] if i and at[i - 1] >= low else -1

    def count(self, mark: str, low: int, high: int) -> int:
        at = self.marks[mark]
        return bisect_left(at, high) - bisect_left(at, low)

    def is_german(self, s: int, e: int) -> bool:
        got = self.german.get((s, e))
        if got is None:
            got = self.german[s, e] = _GERMAN.search(self.text, s, e) is not None
        return got


class Splitter:
    def __init__(self, lexicon: Lexicon | None = None) -> None:
        self.lex = lexicon or Lexicon()
        self.doc = Document("")

    def __call__(self, text: str) -> list[tuple[int, int]]:
        self.doc = Document(text)
        out: list[tuple[int, int]] = []
        thai = _THAI.search(text) is not None
        for s, e, bulleted in blocks(text):
            cuts = [] if bulleted else self.cuts(text, s, e)
            if thai and not bulleted:
                cuts = sorted({*cuts, *(m.start() for m in _THAI_SPACE.finditer(text, s, e))})
            for a, b in zip([s, *cuts], [*cuts, e], strict=True):
                while a < b and text[a].isspace():
                    a += 1
                while b > a and text[b - 1].isspace():
                    b -= 1
                if a < b:
                    out.append((a, b))
        return out

    @staticmethod
    def lookups(text: str) -> set[tuple[str, str]]:
        """Kind and word of all evidence that splitting the text can ask for, cut the way ``period`` and ``ends`` cut it."""
        out: set[tuple[str, str]] = set()
        for s, e, bulleted in blocks(text):
            if bulleted:
                continue
            stops = [m.start() for m in _TERM.finditer(text, s, e) if m[0] == "." and (m.end() >= e or (c := text[m.end()]).isspace() or c in CLOSERS or _is_ideograph(c))]
            if stops:
                out.update(("stop", _bare(_before(text, at, s))) for at in stops)
                out.update(("start", m[0]) for m in _WORD.finditer(text, stops[0], e))
        return out

    def cuts(self, text: str, s: int, e: int) -> list[int]:
        """Positions inside a block where a sentence ends."""
        out: list[int] = []
        open_at = s
        for m in _TERM.finditer(text, s, e):
            end = self.ends(text, m, open_at, s, e)
            if end:
                out.append(end)
                open_at = end
        return out

    def ends(self, text: str, m: re.Match, open_at: int, s: int, e: int) -> int:
        """Where the sentence ends that a terminator closes; 0 if it closes none or the block ends there."""
        run, j = m[0], m.end()
        quoted = False
        while j < e:
            c = text[j]
            if c in CLOSERS:
                if c == "“" and self.doc.last("„", open_at, j) <= self.doc.last("“", open_at, j) or c == '"' and self.doc.count('"', open_at, j) % 2 == 0:
                    break  # it opens a quotation
                quoted |= c in QUOTES
                j += 1
            elif c in "    " and j + 1 < e and text[j + 1] == "»":
                quoted = True
                j += 2
            else:
                break
        k = j
        while k < e and text[k].isspace():
            k += 1
        if k >= e:
            return 0
        last, nxt = run[-1], text[k]
        if last in FULL or (last == "…" and _is_ideograph(nxt) and k == j) or last in UNCASED_STOP:
            if last == "…":
                return 0
            if last in UNCASED_STOP and k == j and nxt in ",،:;":
                return 0
            if quoted and nxt not in OPENERS:
                if nxt in "、，,：" or (nxt == "と" or text.startswith(("って", "という", "との"), k)):
                    return 0
                first = open_at
                while first < j and text[first].isspace():
                    first += 1
                if text[first] in QUOTES:
                    return 0
            return j
        if k == j and not _is_ideograph(nxt):
            return 0
        if _is_ideograph(nxt) and k == j:
            return j if last in "!?" and m.start() > s and _is_ideograph(text[m.start() - 1]) and not quoted else 0
        p, opened = k, False
        while p < e and (text[p] in OPENERS or p > k and text[p] in "\u0020\u00a0\u202f" and text[p - 1] in "«‹"):
            opened |= text[p] in "¿¡"
            p += 1
        if p >= e:
            return j
        c = text[p]
        if c in "—–-" and p + 1 < e and text[p + 1].isspace():
            q = p + 1
            while q < e and (text[q].isspace() or text[q] in OPENERS):
                q += 1
            if q < e and text[q].islower():
                return 0
        word = (w := _WORD.match(text, p, e)) and w[0] or ""
        if c.islower() and not opened:
            if word == word.lower() or word[1:].islower():
                return 0
        elif not c.isalnum() and not opened and c not in "(«“\"‘'[—–-#@$€£§¶†‡*":
            return 0
        if last != "." or len(run) > 1:
            if word and not _cased(word[0]) and quoted and not opened and p == k:
                first = open_at
                while text[first].isspace():
                    first += 1
                return 0 if text[first] in QUOTES else j
            return j
        return j if self.period(text, m.start(), p, word, c, quoted, open_at, s, e) else 0

    def period(self, text: str, at: int, p: int, word: str, c: str, quoted: bool, low: int, s: int, e: int) -> bool:
        """Does the single period at a position end a sentence, given the word that follows?"""
        w = _before(text, at, s)
        if not w:
            return True
        if _devanagari(w[-1]) and not c.isdigit():
            return False
        bare = _bare(w)
        if w != bare and "°" in w:
            return True
        if quoted and len(bare) > 1:
            return True
        if _number(w):
            if not c.isalpha() or not self.doc.is_german(s, e) or len(w) > 2:
                return True
            return self.starts(text, word, p + len(word), e, False)
        if not bare or not bare[-1].isalpha():
            return True
        if not _cased(bare[-1]) and len(bare) > 1:  # scripts without capitals
            return not self.short(text, bare, None)
        if len(bare) <= 2 and bare.isupper() and len(word) <= 2 and word.isupper() and text[p + len(word) : p + len(word) + 1] == ".":
            return False  # initials and the like
        if not self.short(text, bare, c):
            return True
        low_w = bare.lower()
        f = self.lex.stop.get(bare)
        if c.isdigit():
            if low_w in NUMBERED or low_w in TITLES or len(bare) == 1:
                return False
            return not (f and f[2] > 0.2 * sum(f))
        if low_w in TITLES:
            return False
        if word and p + len(word) < e and text[p + len(word)] == "." and re.match(r"\.\s*\d", text[p + len(word) : p + len(word) + 6]):
            return False  # an abbreviation before a number goes on with the one before it
        return self.starts(text, word, p + len(word), e, low_w not in NUMBERED and not (len(bare) == 1 and (bare.isupper() or not _cased(bare))))

    def short(self, text: str, w: str, c: str | None) -> bool:
        """Is the word an abbreviation? The document's own unambiguous uses decide, then the corpus, then the shape."""
        if len(w) == 1 or "." in w:
            return True
        low = w.lower()
        if low in TITLES or low in NUMBERED:
            return True
        n, yes, no = self.doc.stops.get(w, (0, 0, 0))
        if n > 1:
            if yes and not no:
                return True
            if no and not yes and w not in self.lex.stop:
                return False
        f = self.lex.stop.get(w)
        if f is None:
            return False
        lower, comma, digit, capital = f
        return lower + comma + digit >= 0.05 * sum(f) and lower + comma + digit >= 2

    def starts(self, text: str, word: str, after: int, e: int, unknown: bool) -> bool:
        """Does the capitalised word start a sentence, or is it a name?"""
        if not word:
            return unknown
        if after < e and text[after] == ":":
            return True
        low = word.lower()
        if low != word:
            if len(word) > 1 and low in self.doc.within:
                return True
        f = self.lex.start.get(word)
        if f is None:
            return unknown
        initial, middle, small, _ = f
        if initial == middle == small == 0:
            return unknown
        return small > 0.2 * middle or initial > 0.1 * (initial + middle)


def _follows(text: str, i: int) -> str:
    n = len(text)
    if i < n and text[i] in ",;:)":
        return "comma" if text[i] != ")" else "other"
    k = i
    while k < n and text[k].isspace():
        k += 1
    if k >= n:
        return "end"
    if k == i:
        return "other"
    c = text[k]
    if c.islower():
        w = _WORD.match(text, k)
        return "lower" if w and w[0] == w[0].lower() else "other"
    return "digit" if c.isdigit() else "capital" if c.isupper() else "other"


_PART = r"[^\s\"“”«»()\[\]{},;:!?‘’/=<>.]"
#: A word before a period; anchored where a word begins and without going back, so that no text takes more than linear time.
_STOP = re.compile(rf"(?<!{_PART})(?<!{_PART}\.)({_PART}++(?:\.{_PART}++)*+)\.(?=[\s,;:])")
#: The last part of a word before a period.
_LAST = re.compile(rf"(?<!{_PART})({_PART}++)\.")
_SPACED = re.compile(r"(?<= )[^ ,]++(?=[ ,])")
_QUOTE = re.compile('[„“"]')
_ANY = re.compile(r"(?:^|(?<=[\s(\"'“‘«„¿¡]))[^\W\d_]+(?:[-'’][^\W\d_]+)*")


def count_words(texts: Iterator[str | None]) -> tuple[dict[str, list[int]], dict[str, list[int]]]:
    """Corpus counts of some texts. Of a word before a period: followed by a small letter, a comma, a number, a capital. Of a capitalised word: at an unambiguous start, within a sentence, in small letters, after a possible abbreviation."""
    stop: dict[str, list[int]] = {}
    initial: Counter[str] = Counter()
    middle: Counter[str] = Counter()
    small: Counter[str] = Counter()
    after: Counter[str] = Counter()
    kinds = {"lower": 0, "comma": 1, "digit": 2, "capital": 3}
    for t in texts:
        if not t:
            continue
        for m in _STOP.finditer(t):
            w = m[1]
            if w[-1].isalpha():
                k = kinds.get(_follows(t, m.end()))
                if k is not None:
                    if w not in stop:
                        stop[w] = [0, 0, 0, 0]
                    stop[w][k] += 1
        for m in _ANY.finditer(t):
            w = m[0]
            if w.islower():
                small[w] += 1
                continue
            if w == w.lower():
                continue
            i = m.start() - 1
            while i >= 0 and (t[i].isspace() or t[i] in "\"'“‘«„(¿¡"):
                i -= 1
            if i < 0 or t[i] in "!?":
                initial[w] += 1
            elif t[i] == ".":
                b = _before(t, i, 0)
                if len(b) > 4 and "." not in b and b.islower():
                    initial[w] += 1
                else:
                    after[w] += 1
            elif t[i] in ")]”»'\"’":
                pass
            else:
                middle[w] += 1
    start = {w: [initial[w], middle[w], small.get(w.lower(), 0), after[w]] for w in {*initial, *middle, *after}}
    for w, n in small.items():
        start.setdefault(w, [0, 0, n, 0])
    return stop, start


COUNTS = "kind string, word string, a bigint, b bigint, c bigint, d bigint"


def _counted(table: dict[tuple[str, str], list[int]]) -> pa.RecordBatch:
    words, counts = [*zip(*table, strict=True)] or [[], []], [*zip(*table.values(), strict=True)] or [[]] * 4
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in words), *(pa.array(x, pa.int64()) for x in counts)], names=["kind", "word", "a", "b", "c", "d"])


def corpus_counts(docs: DataFrame) -> DataFrame:
    """Counts over all texts: each task counts into its own table first, so only its vocabulary is shuffled. Nothing is left out before the sum, so batches and partitions do not matter; after it the words are kept that can matter: words before a period that something but a capital follows, and capitalised words met after one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[tuple[str, str], list[int]] = {}
        for b in batches:
            stop, start = count_words(b.column("text").to_pylist())
            rows = [("stop", w, n) for w, n in stop.items()]
            rows += [("start", w, [n[0], n[1], 0, n[3]]) for w, n in start.items() if w != w.lower()]  # small letters are counted once, by the next line
            rows += [("small", w, [0, 0, n[2], 0]) for w, n in start.items() if w == w.lower()]
            for kind, w, n in rows:
                held = table.get((kind, w))
                table[kind, w] = n if held is None else [x + y for x, y in zip(held, n, strict=True)]
            if len(table) > MOST_TABLE:
                yield _counted(table)
                table = {}
        yield _counted(table)

    total = docs.mapInArrow(run, COUNTS).groupBy("kind", "word").agg(*[F.sum(c).alias(c) for c in "abcd"])
    total = written(total, "word-counts")
    stops = total.where("kind = 'stop' and a + b + c > 0")
    starts = total.where("kind = 'start' and d > 0")
    small = total.where("kind = 'small'").select(F.col("word").alias("low"), F.col("c").alias("more"))
    known = starts.join(small, F.lower(starts["word"]) == small["low"], "left").select("kind", "word", "a", "b", (F.col("c") + F.coalesce("more", F.lit(0))).alias("c"), "d")
    return stops.unionByName(known)


def split(docs: DataFrame, *, keys: list[str], text: str = "text", most_lexicon: int = MOST_LEXICON) -> DataFrame:
    """``keys``, ``char_start`` int and ``char_end`` int of every sentence.

    Up to ``most_lexicon`` words of corpus evidence are broadcast. Beyond that every text fetches the evidence of its own words
    by a join and is split with those, to the same result.
    """
    docs = docs.select(*keys, F.col(text).alias("text"))
    counts = written(corpus_counts(docs.select("text")), "sentence-lexicon")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema) + ", char_start int, char_end int"
    if counts.count() > most_lexicon:
        return _split_with_join(docs, counts, keys, schema)
    shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in bounded(counts, most_lexicon, "sentence lexicon")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(Lexicon(iter(shared.value)))
        for b in batches:
            yield _emit(b, keys, [splitter(t) if t else [] for t in b.column("text").to_pylist()])

    return docs.mapInArrow(run, schema)


def _emit(b: pa.RecordBatch, keys: list[str], found: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    at = pa.array([i for i, x in enumerate(found) for _ in x], pa.int32())
    flat = [y for x in found for y in x]
    return pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in keys), pa.array([y[0] for y in flat], pa.int32()), pa.array([y[1] for y in flat], pa.int32())], names=[*keys, "char_start", "char_end"])


def _split_with_join(docs: DataFrame, counts: DataFrame, keys: list[str], schema: str) -> DataFrame:
    """The same with a lexicon of any size: the words of each text meet their counts in a shuffle."""
    docs = docs.where(F.length("text") > 0).withColumn("_row", F.unhex(F.md5(F.to_json(F.struct(*keys, "text")))))
    docs = written(docs, "texts-to-split")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = [sorted(Splitter.lookups(t)) for t in b.column("text").to_pylist()]
            at = pa.array([i for i, x in enumerate(asked) for _ in x], pa.int32())
            flat = [y for x in asked for y in x]
            yield pa.RecordBatch.from_arrays([b.column("_row").take(at), pa.array([y[0] for y in flat], pa.string()), pa.array([y[1] for y in flat], pa.string())], names=["_row", "kind", "word"])

    words = docs.select("_row", "text").mapInArrow(ask, "_row binary, kind string, word string").distinct()
    own = words.join(counts, ["kind", "word"]).groupBy("_row").agg(F.collect_list(F.struct("kind", "word", "a", "b", "c", "d")).alias("lex"))  # at most a text's own words
    joined = docs.join(own, "_row", "left").select(*keys, "text", "lex")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for t, rows in zip(b.column("text").to_pylist(), b.column("lex").to_pylist(), strict=True):
                found.append(Splitter(Lexicon(tuple(r.values()) for r in rows or ()))(t))
            yield _emit(b, keys, found)

    return joined.mapInArrow(run, schema)


def documents_of(full_text: DataFrame, claims: DataFrame) -> DataFrame:
    a = full_text.select(F.lit("full_text").alias("src"), F.col("fulltext_id").alias("record_id"), F.col("abstract").alias("text"))
    b = claims.select(F.lit("extracted_claims").alias("src"), F.col("claim_row_id").alias("record_id"), F.col("evidence_snippet").alias("text"))
    return a.unionByName(b).where("length(text) > 0")


def found(full_text: DataFrame, claims: DataFrame, **how: int) -> DataFrame:
    return split(documents_of(full_text, claims), keys=["src", "record_id"], **how)
