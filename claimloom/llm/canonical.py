"""Problem 1: map freely typed values to the entries of a reference list.

Method: the reference list becomes a symmetric-delete dictionary that is built once, on the driver, and broadcast. Words are
looked up with a bounded edit distance through their deletes; phrases are ranked by weighted Damerau-Levenshtein distance, then by
how often the reference entry is met exactly in the corpus, then by the smaller id. What finds no entry is reported with id 0.

A dictionary holds at most ``most_names`` names and aliases, which bounds its size (a name of w words leaves at most 79 deletes a
word of 12 letters; 5,000 names leave about 50 MB). A longer list is divided into dictionaries of that size, every value is looked up
in each, and the best answer wins by the same order as within one dictionary, so the result is the same whatever the division.
Each distinct value is looked up once; its answer is joined back to all its rows.

Digits never take part in an edit, so codes and numbers have to agree. The order of words does not matter ("miso, rice").
Values that are null or blank yield no row of the queries and id 0 in ``map_values``. Values of any length are read whole: what may
be cut from the end of a value is cut as often as it is there, and a form that is longer than all entries is left out only because
no entry within the bound can have as many letters. Repeated values count each time. An empty list maps all to 0.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.session import bounded, written

#: Words that say how a value was measured or taken, not what it is; dropped from the end of a value only where the whole value is unknown. The default of a parameter.
TRAILING_NOISE = ("level", "levels", "concentration", "concentrations", "value", "values", "change", "mean", "intake", "consumption", "product", "products", "plain", "at follow up")
#: Words dropped before a code. The default of a parameter.
CODE_NOISE = ("strain", "str")
#: Words whose neighbours a task remembers.
MEMO = 200_000
#: Names and aliases in one dictionary.
MOST_NAMES = 5_000
#: Letters by which a value without its spaces may be longer than an entry it matches.
SLACK = 3

_SPLIT = re.compile(r"[\W_]+")
_CODE = re.compile(r"^(?:[a-z]{1,3}\d+|\d+[a-z]{0,2})$")
_MARK = re.compile(r"[̀-ͯ]")
_HIDDEN = re.compile(r"[­​-‏⁠﻿]")
_VOWELS = frozenset("aeiouy")
_SPELLING = (("ae", "e"), ("oe", "e"), ("ph", "f"), ("gh", "g"), ("ou", "u"))


def fold(text: str) -> str:
    """Compatibility form, case-folded, without diacritics and invisible characters."""
    text = _HIDDEN.sub("", text)
    if not text.isascii():
        text = _MARK.sub("", unicodedata.normalize("NFKD", text)).replace("α", "a").replace("Α", "a")
    return text.casefold()


def words(text: str) -> tuple[str, ...]:
    """The words of a folded text; a short letter group and the number after it form one code."""
    out: list[str] = []
    for w in _SPLIT.split(fold(text)):
        if not w:
            continue
        if out and w.isdigit() and out[-1].isalpha() and len(out[-1]) <= 3 and len(out[-1]) >= 2:
            out[-1] += w
        else:
            out.append(w)
    return tuple(out)


def spelling(word: str) -> str:
    """A word without the letter pairs in which spellings of one language differ, and without doubled letters."""
    for a, b in _SPELLING:
        word = word.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", word)


def weighted_distance(a: str, b: str, most: float) -> float:
    """Damerau-Levenshtein with weights; ``inf`` beyond ``most``.

    A doubled letter or a swap costs less than another letter, a vowel for a vowel less than other substitutions, and a digit
    can't be edited. Swapped letters may have had others between them (the unrestricted form).
    """
    if a == b:
        return 0.0
    inf = float("inf")
    n, m = len(a), len(b)
    if abs(n - m) > most / 0.6:
        return inf
    drop = [inf if x.isdigit() else 0.6 if i and x == a[i - 1] else 1.0 for i, x in enumerate(a)]
    add = [inf if y.isdigit() else 0.6 if j and y == b[j - 1] else 1.0 for j, y in enumerate(b)]
    digits = not (a.isalpha() and b.isalpha())
    rows = [[0.0] * (m + 1) for _ in range(n + 1)]
    for j in range(m):
        rows[0][j + 1] = rows[0][j] + add[j]
    last: dict[str, int] = {}
    for i in range(1, n + 1):
        x, row, prev, at, cut = a[i - 1], rows[i], rows[i - 1], 0, drop[i - 1]
        vowel, number = x in _VOWELS, digits and x.isdigit()
        left = low = row[0] = prev[0] + cut
        for j, y in enumerate(b, 1):
            best = prev[j - 1]
            if x != y:
                best += inf if number or digits and y.isdigit() else 0.8 if vowel and y in _VOWELS else 1.0
                if at and (k := last.get(y, 0)):
                    swapped = rows[k - 1][at - 1] + (i - k - 1) + 0.8 + (j - at - 1)
                    if swapped < best:
                        best = swapped
            other = left + add[j - 1]
            if other < best:
                best = other
            other = prev[j] + cut
            if other < best:
                best = other
            if x == y:
                at = j
            row[j] = left = best
            if best < low:
                low = best
        if low > most + 1:
            return inf
        last[x] = i
    return rows[n][m] if rows[n][m] <= most else inf


def deletes(word: str, most: int) -> set[str]:
    """The word and all forms of it with up to ``most`` letters left out."""
    out, last = {word}, {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out |= last
    return out


def word_bound(n: int) -> int:
    """Edits allowed in a word of n letters."""
    return 0 if n < 3 else 1 if n < 6 else 2


def phrase_bound(n: int) -> float:
    """Weighted edits allowed in a phrase of n letters."""
    return 0.0 if n < 4 else 1.0 if n < 7 else 2.0 if n < 12 else 3.0


@dataclass
class Dictionary:
    """Symmetric-delete dictionary over the names and aliases of a reference list."""

    phrases: dict[tuple[str, ...], list[int]] = field(default_factory=dict)
    squashed: dict[str, list[int]] = field(default_factory=dict)
    vocabulary: set[str] = field(default_factory=set)
    by_delete: dict[str, list[str]] = field(default_factory=dict)
    whole_by_delete: dict[str, list[str]] = field(default_factory=dict)
    spelled: dict[str, list[str]] = field(default_factory=dict)
    most_words: int = 0
    longest: int = 0
    weight: dict[int, int] = field(default_factory=dict)

    @classmethod
    def build(cls, entries: Iterable[tuple[int, str, list[str] | None]], weight: dict[int, int] | None = None, code_noise: Sequence[str] = CODE_NOISE) -> Dictionary:
        self = cls(weight=weight or {})
        phrases: dict[tuple[str, ...], set[int]] = defaultdict(set)
        squashed: dict[str, set[int]] = defaultdict(set)
        for i, name, aliases in entries:
            for text in (name, *(aliases or ())):
                w = words(text or "")
                if not w:
                    continue
                forms = [w]
                if len(w) >= 3 and _CODE.match(w[-1]) and len(w[0]) > 3 and w[0].isalpha():  # a genus may be abbreviated
                    forms.append((w[0][0], *w[1:]))
                for f in forms:
                    phrases[tuple(sorted(f))].add(i)
                    for k in range(len(f)):  # the head word may have been moved to the front
                        squashed["".join((*f[k:], *f[:k]))].add(i)
                    if _CODE.match(f[-1]) and len(f) >= 3 and code_noise:
                        squashed["".join((*f[:-1], code_noise[0], f[-1]))].add(i)
                    self.vocabulary.update(f)
        self.phrases = {k: sorted(v) for k, v in phrases.items()}
        self.squashed = {k: sorted(v) for k, v in squashed.items()}
        self.most_words = max(map(len, self.phrases), default=0)
        self.longest = max(map(len, self.squashed), default=0)
        by: dict[str, set[str]] = defaultdict(set)
        spelled: dict[str, set[str]] = defaultdict(set)
        for w in self.vocabulary:
            spelled[spelling(w)].add(w)
            if w.isalpha():
                for d in deletes(w, word_bound(len(w))):
                    by[d].add(w)
        self.by_delete = {k: sorted(v) for k, v in by.items()}
        self.spelled = {k: sorted(v) for k, v in spelled.items()}
        whole: dict[str, set[str]] = defaultdict(set)
        for s in self.squashed:
            if len(s) >= 7:
                for d in deletes(s[:7], 2):  # lossless for two edits: such texts share a delete of their first letters
                    whole[d].add(s)
        self.whole_by_delete = {k: sorted(v) for k, v in whole.items()}
        return self

    def near(self, word: str) -> list[tuple[str, float]]:
        """Words of the list within the bound, nearest first."""
        out = {w: 0.0 for w in (word,) if word in self.vocabulary}
        for w in self.spelled.get(spelling(word), ()):
            out.setdefault(w, 0.3)
        most = word_bound(len(word))
        if most and word.isalpha():
            for d in deletes(word, most):
                for w in self.by_delete.get(d, ()):
                    if w not in out or out[w] > 0.3:
                        x = weighted_distance(word, w, min(most, word_bound(len(w))))
                        if x < out.get(w, float("inf")):
                            out[w] = x
            flat = spelling(word)
            if flat != word and len(flat) > 3:
                for d in deletes(flat, 1):
                    for w in self.by_delete.get(d, ()):
                        x = 0.3 + weighted_distance(flat, w, 1)
                        if x < out.get(w, float("inf")):
                            out[w] = x
        return sorted(out.items(), key=lambda x: (x[1], x[0]))

    def rank(self, ids: Sequence[int]) -> int:
        return min(ids, key=lambda i: (-self.weight.get(i, 0), i))


#: An answer: how it was found (0 as it stands, 1 without spaces, 2 by its words, 3 as a whole with edits), the cost of that, minus the entry's weight, its id, and the distance. Of several the smallest counts; id 0 is none.
Answer = tuple[int, float, int, int, float]
NONE: Answer = (9, 0.0, 0, 0, 0.0)


class Matcher:
    """Looks values up in a dictionary."""

    def __init__(self, dictionary: Dictionary, noise: Sequence[str] = TRAILING_NOISE, code_noise: Sequence[str] = CODE_NOISE) -> None:
        self.d = dictionary
        self.near: dict[str, list[tuple[str, float]]] = {}
        self.noise = sorted((tuple(x.split()) for x in noise), key=len, reverse=True)
        self.code_noise = tuple(code_noise)
        self.tails = sorted(("".join(n) for n in self.noise), key=len, reverse=True)

    def __call__(self, value: str) -> tuple[int, float]:
        """Id of the best entry and its distance; id 0 where the list holds none."""
        got = self.answer(value)
        return got[3], got[4]

    def answer(self, value: str) -> Answer:
        w = words(value)
        if not w:
            return NONE
        most = self.d.longest + SLACK  # a form of more words, each a letter at least, matches nothing
        forms = [(0, w)] if len(w) <= most else []
        k, end = 1, len(w)
        if len(w) >= 2 and w[-2] in self.code_noise and _CODE.match(w[-1]):
            if len(w) - 1 <= most:
                forms.append((1, (*w[:-2], w[-1])))
            k += 1
        while True:
            for n in self.noise:
                if end > len(n) and w[end - len(n) : end] == n:
                    end -= len(n)
                    if end <= most:
                        forms.append((k, w[:end]))
                    k += 1
                    break
            else:
                break
        for k, f in forms:
            for step, ids in enumerate((self.d.phrases.get(tuple(sorted(f))), self.d.squashed.get("".join(f)))):
                if ids:
                    return self._ranked(0, 2 * k + step, ids, 0.1 * k)
        joined = self._joined("".join(w), most)
        for k, s in joined:
            if s in self.d.squashed:
                return self._ranked(1, k, self.d.squashed[s], 0.1 * k)
        best = min((self._ranked(2, cost + 0.1 * k, (i,), cost + 0.1 * k) for k, f in forms for cost, i in self._phrase(f)), default=NONE)
        if best is NONE:
            best = min((self._ranked(3, cost + 0.1 * k, (i,), cost + 0.1 * k) for k, s in joined for cost, i in self._whole(s)), default=NONE)
        return best

    def _ranked(self, how: int, cost: float, ids: Sequence[int], distance: float) -> Answer:
        i = self.d.rank(ids)
        return how, cost, -self.d.weight.get(i, 0), i, distance

    def _joined(self, s: str, most: int) -> list[tuple[int, str]]:
        """A text without its spaces, and the same without the noise at its end; those that no entry is as long as are left out."""
        out, k, end = [], 0, len(s)
        while True:
            if end <= most:
                out.append((k, s[:end]))
            for n in self.tails:
                if end > len(n) + 2 and s.endswith(n, 0, end):
                    end -= len(n)
                    k += 1
                    break
            else:
                return out

    def _near(self, word: str) -> list[tuple[str, float]]:
        got = self.near.get(word)
        if got is None:
            if len(self.near) >= MEMO:
                self.near.clear()
            got = self.near[word] = self.d.near(word)
        return got

    def _phrase(self, f: tuple[str, ...]) -> Iterator[tuple[float, int]]:
        if len(f) > self.d.most_words:  # word stands for word, so no entry has as many
            return
        most = phrase_bound(sum(map(len, f)))
        choices = [self._near(w) for w in f]
        if any(not c for c in choices):
            return

        def walk(k: int, chosen: tuple[str, ...], cost: float) -> Iterator[tuple[float, int]]:
            if k == len(choices):
                for i in self.d.phrases.get(tuple(sorted(chosen)), ()):
                    yield cost, i
                return
            for w, x in choices[k]:
                if cost + x > most:
                    break
                yield from walk(k + 1, (*chosen, w), cost + x)

        yield from walk(0, (), 0.0)

    def _whole(self, s: str) -> Iterator[tuple[float, int]]:
        """Values whose spaces are missing or misplaced."""
        if len(s) < 7:
            return
        most = min(2.0, phrase_bound(len(s)))
        digits = [c for c in s if c.isdigit()]
        seen: set[str] = set()
        for d in deletes(s[:7], 2):
            for t in self.d.whole_by_delete.get(d, ()):
                if t not in seen:
                    seen.add(t)
                    if abs(len(t) - len(s)) <= 2 and digits == [c for c in t if c.isdigit()]:
                        x = weighted_distance(s, t, most)
                        if x <= most:
                            for i in self.d.squashed[t]:
                                yield x, i


def weighted(reference: DataFrame, counts: DataFrame, *, value: str = "value", count: str = "count") -> DataFrame:
    """``reference`` with ``weight``: how often each entry's own name is met in the values, regardless of case and punctuation. ``counts`` holds the values with their number; an entry of a name that several share is the smallest id."""
    key = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    names = reference.select("canonical_id", key(F.col("canonical_name")).alias("_k")).where("_k <> ''").groupBy("_k").agg(F.min("canonical_id").alias("canonical_id"))
    met = counts.groupBy(key(F.col(value)).alias("_k")).agg(F.sum(count).alias("_n"))
    n = names.join(met, "_k").groupBy("canonical_id").agg(F.sum("_n").alias("weight"))
    return reference.drop("weight").join(n, "canonical_id", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))


def map_values(df: DataFrame, reference: DataFrame, *, value: str = "value", most_names: int = MOST_NAMES, noise: Sequence[str] = TRAILING_NOISE, code_noise: Sequence[str] = CODE_NOISE) -> DataFrame:
    """Add ``canonical_id`` int (0: the list holds none) and ``distance`` double to every row of ``df``.

    ``reference`` has canonical_id, canonical_name, known_aliases and, if wanted, ``weight``. Columns of ``df`` named canonical_id or
    distance are replaced.
    """
    df = df.drop("canonical_id", "distance")
    asked = df.select(F.col(value).alias("value")).where("value is not null").distinct()
    got = written(answers(asked, reference, most_names=most_names, noise=noise, code_noise=code_noise), "answers").withColumnRenamed("value", "_value")
    out = df.join(got, F.col(value) == F.col("_value"), "left").drop("_value")
    return out.withColumns({"canonical_id": F.coalesce("canonical_id", F.lit(0)), "distance": F.coalesce("distance", F.lit(0.0))})


def answers(asked: DataFrame, reference: DataFrame, *, most_names: int = MOST_NAMES, noise: Sequence[str] = TRAILING_NOISE, code_noise: Sequence[str] = CODE_NOISE) -> DataFrame:
    """``value``, ``canonical_id``, ``distance`` of the distinct values of ``asked``; without a row, or with id 0, where the list holds none."""
    weight = F.col("weight") if "weight" in reference.columns else F.lit(0)
    names = reference.select(F.col("canonical_id").cast("int").alias("i"), F.explode(F.concat(F.array("canonical_name"), F.coalesce("known_aliases", F.array().cast("array<string>")))).alias("name"), weight.cast("bigint").alias("w")).where("i is not null and name is not null").distinct()
    n = names.count()
    pieces = 1 if n <= most_names else -(-n // most_names) * 2  # by hash, so half full on average
    part = F.pmod(F.xxhash64("i", "name"), F.lit(pieces))
    found_in = []
    for p in range(pieces):
        rows = bounded(names if pieces == 1 else names.where(part == p), 2 * most_names + 100, "names in a dictionary")
        d = Dictionary.build(((r["i"], r["name"], None) for r in sorted(rows)), {r["i"]: r["w"] for r in rows if r["w"]}, code_noise)
        found_in.append(_lookup(asked, d, noise, code_noise))
    if pieces == 1:
        return found_in[0].select("value", "canonical_id", "distance")
    every = reduce(DataFrame.unionByName, found_in).where("canonical_id > 0")
    best = every.groupBy("value").agg(F.min(F.struct("how", "cost", "weight", "canonical_id", "distance")).alias("b"))
    return best.select("value", "b.canonical_id", "b.distance")


def _lookup(asked: DataFrame, dictionary: Dictionary, noise: Sequence[str], code_noise: Sequence[str]) -> DataFrame:
    shared = asked.sparkSession.sparkContext.broadcast(dictionary)  # of at most ``most_names`` names, see above
    types = (pa.int32(), pa.float64(), pa.int64(), pa.int32(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(shared.value, noise, code_noise)
        for b in batches:
            got = [match.answer(v) for v in b.column("value").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("value"), *(pa.array([x[i] for x in got], t) for i, t in enumerate(types))], names=["value", "how", "cost", "weight", "canonical_id", "distance"])

    return asked.select("value").mapInArrow(run, "value string, how int, cost double, weight bigint, canonical_id int, distance double")


def _stated(c: Column) -> Column:
    """Neither null nor blank, whatever the blanks."""
    return c.isNotNull() & c.rlike(r"[^\s  -​  ⁠　﻿]")


def typed_values(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """All freely typed values as rows record_id, field, pos, value; nulls and blanks are left out."""
    flat = claims.select(F.col("claim_row_id").alias("record_id"), F.expr("stack(2, 'subject_name', subject_name, 'object_name', object_name) as (field, value)")).select("record_id", "field", F.lit(0).alias("pos"), "value")
    listed = entities.select(F.col("entity_id").alias("record_id"), F.lit("aliases").alias("field"), F.posexplode("aliases").alias("pos", "value"))
    return flat.unionByName(listed).where(_stated(F.col("value")))


def found(claims: DataFrame, entities: DataFrame, reference: DataFrame) -> DataFrame:
    """Every typed value that is not, character for character, a canonical name, with its entry or 0."""
    values = typed_values(claims, entities)
    counts = written(values.groupBy("value").count(), "typed-values")
    asked = counts.join(reference.select(F.col("canonical_name").alias("value")), "value", "left_anti")
    got = written(asked.select("value").join(answers(asked, weighted(reference, counts)), "value", "left"), "answers")
    return values.join(got, "value").select("record_id", "field", "pos", F.coalesce("canonical_id", F.lit(0)).alias("canonical_id"))


def misses(claims: DataFrame, entities: DataFrame, reference: DataFrame) -> DataFrame:
    """The values no entry was found for, in lower case and single spaces, with how often and in which fields they occur."""
    values = typed_values(claims, entities)
    counts = written(values.groupBy("value").count(), "typed-values")
    got = answers(counts, weighted(reference, counts)).where("canonical_id > 0").select("value")
    missed = written(counts.select("value").join(got, "value", "left_anti"), "missed-values")
    mapped = values.join(missed, "value")
    flat = F.trim(F.regexp_replace(F.lower("value"), r"[\s_]+", " "))
    return mapped.groupBy(flat.alias("value"), "field").agg(F.count("*").alias("n"), F.countDistinct("record_id").alias("n_records"))
