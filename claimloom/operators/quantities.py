"""Problem 4: quantities recorded in different units, converted to common units.

Method: unit strings are segmented by dynamic programming over tries of prefixes, roots and exponents
(``functions.unit_grammar``), and ambiguous readings are scored with the dimension the field is expected to have. The texts are
read in Arrow batches with a bounded memo of unit strings; only effects move, to meet the one row their article keeps for the
outcome.

Null, blank and unreadable texts, counted portions, ranges, percentages, ratios and standardised effects yield no row, nor does
a value that has no place in 64 bits after conversion. Repeated rows yield as many rows. If an article records an outcome in
several rows, the unit is that of the smallest outcome_row_id that has one. Empty tables yield no row. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.unit_grammar import Grammar, leading_number
from claimloom.session import bounded

MASS, VOLUME, COUNT, TIME = ((("g", 1),), (("L", 1),), (("CFU", 1),), (("day", 1),))
OUT = "claim_row_id bigint, field string, common_unit string, value_milli bigint"
MEMO = 200_000

#: Words for how often a day. Fixed values.
TIMES = {"once": 1, "one": 1, "twice": 2, "two": 2, "thrice": 3, "three": 3, "four": 4, "five": 5, "six": 6}
LATIN = {"q.d": 1, "qd": 1, "o.d": 1, "od": 1, "b.i.d": 2, "bid": 2, "b.d": 2, "bd": 2, "t.i.d": 3, "tid": 3, "t.d.s": 3, "tds": 3, "q.i.d": 4, "qid": 4}
DAYS = {"d": 1, "day": 1, "days": 1, "daily": 1, "wk": 7, "w": 7, "week": 7, "weekly": 7, "mo": 30, "month": 30, "monthly": 30, "yr": 365, "year": 365, "yearly": 365}
_PERIOD = r"(?:d|days?|wk|w|week|mo|month|yr|year)"
_OFTEN = re.compile(
    rf"(?:^|(?<=[\s/)])|(?<=\w)(?=/)|(?<=\.)(?=/))\s*(?:(?P<latin>{'|'.join(map(re.escape, sorted(LATIN, key=len, reverse=True)))})\.?|every\s+other\s+(?P<other>day)"
    rf"|(?:(?P<word>once|twice|thrice|(?:one|two|three|four|five|six)\s+times?)|(?P<n>\d+)\s*(?:x|×|times?))?\s*(?:(?:/|per|an?|each|every)\s*(?P<per>{_PERIOD})|(?P<ly>daily|weekly|monthly|yearly)))\.?\s*$",
    re.I,
)


def split_frequency(text: str) -> tuple[str, float]:
    """A text without the frequency at its end, and how many times a day that is; an amount without one is per day."""
    m = _OFTEN.search(text)
    if not m:
        return text, 1.0
    rest = text[: m.start()].strip()
    if m["latin"]:
        return rest, float(LATIN[m["latin"].lower()])
    if m["other"]:
        return rest, 0.5
    times = int(m["n"]) if m["n"] else TIMES[m["word"].split()[0].lower()] if m["word"] else 1
    return rest, times / DAYS[(m["per"] or m["ly"]).lower()]


def milli(value: float) -> int | None:
    """Thousandths as a 64-bit integer."""
    if not math.isfinite(value) or abs(value) * 1000 >= 2.0**63:
        return None
    return round(value * 1000)


def read_dose(value: str | None, unit: str | None, grammar: Grammar) -> tuple[str, int] | None:
    """Common unit and thousandths of a daily dose."""
    text = " ".join(x.strip() for x in (value, unit) if x and x.strip())
    got = leading_number(text)
    if not got:
        return None
    amount, rest = got
    unit_text, often = split_frequency(rest)
    r = grammar.read(unit_text.strip(), (MASS, VOLUME, COUNT))
    if r is None:
        return None
    common, scale = {MASS: ("mg/day", 1e3), VOLUME: ("mL/day", 1e3), COUNT: ("CFU/day", 1.0)}[r.dim]
    out = milli(_times(amount, r.scale * scale) * often)
    return None if out is None else (common, out)


def _times(a: float, b: float) -> float:
    """A product without the last digits that powers of ten leave in binary."""
    return float(f"{a * b:.14g}")


def read_duration(text: str | None, grammar: Grammar) -> tuple[str, int] | None:
    """Thousandths of days."""
    if not text:
        return None
    t = re.sub(r"^\s*(?:for|over|during|about|approx\.?|ca\.?|up\s+to|a\s+total\s+of)\s+", "", text.strip(), flags=re.I)
    got = leading_number(t)
    if not got:
        return None
    r = grammar.read(got[1].strip().lstrip("-–‑ ").rstrip(". "), (TIME,))
    out = milli(_times(got[0], r.scale)) if r else None
    return None if out is None else ("day", out)


_DIFFERENCE = re.compile(r"^\s*(?:(?:weighted\s+)?mean\s+difference|w?md|difference|change|delta|diff\.?|Δ|∆|β)?\s*[:=]?\s*", re.I)


def read_effect(text: str | None, unit: str | None, common: str | None, molar_mass: float | None, grammar: Grammar) -> tuple[str, int] | None:
    """An absolute effect's estimate in the measure's common unit; the unit in the text prevails over the recorded one."""
    if not text or not common:
        return None
    m = _DIFFERENCE.match(text)
    rest = text[m.end() :]
    sign = re.match(r"\s*([-+−–‐‑])?\s*(?=[\d.,])", rest)
    if not sign:
        return None
    got = leading_number(rest[sign.end() :])
    if not got:
        return None
    value, tail = got
    written = re.split(r"[(\[;]|,\s|\s±", tail, maxsplit=1)[0].strip().rstrip(",")
    target = grammar.read(common, None)
    if target is None:
        return None
    expected = (target.dim, *other_dims(target.dim, molar_mass))
    r = grammar.read(written if written else (unit or ""), expected)
    if r is None:
        return None
    base = value * r.scale
    if r.dim != target.dim:
        base = base / molar_mass if ("mol", 1) in target.dim else base * molar_mass
    out = milli(float(f"{base / target.scale:.13g}") * (-1 if sign[1] and sign[1] != "+" else 1))
    return None if out is None else (common, out)


def other_dims(dim: tuple, molar_mass: float | None) -> tuple:
    """Dimensions that a molar mass turns into the given one."""
    if not molar_mass or math.isnan(molar_mass):
        return ()
    swap = {"mol": "g", "g": "mol"}
    return tuple({tuple(sorted((swap.get(u, u), n) for u, n in dim))} - {dim})


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def found(claims: DataFrame, outcomes: DataFrame, measures: DataFrame, constants: DataFrame) -> DataFrame:
    """Every stated dose, duration and absolute effect in its common unit."""
    table = tuple((r["unit"], r["base_unit"], r["factor"]) for r in bounded(constants.select("unit", "base_unit", "factor").where("unit is not null and factor is not null"), 10_000, "unit constants"))
    known = {r["measure_code"]: (r["common_unit"], r["molar_mass"]) for r in bounded(measures.select("measure_code", "common_unit", "molar_mass"), 100_000, "measures")}
    d = F.col("dose_info")
    # the claims are read once for doses and durations, which stay where they are, and once for effects, without the texts that have no digit
    doses = claims.select("claim_row_id", d["value"].alias("value"), d["unit"].alias("unit"), d["duration"].alias("duration")).where("claim_row_id is not null and (value is not null or unit is not null or duration is not null)")
    stated = claims.select("claim_row_id", _trim(F.col("pmid")).alias("pmid"), F.col("object_name").alias("name"), F.col("effect_size").alias("text")).where(F.col("claim_row_id").isNotNull() & F.col("text").rlike(r"\d"))
    rank = F.struct(F.when(F.length(_trim(F.col("unit"))) > 0, 0).otherwise(1), "outcome_row_id")
    per_outcome = outcomes.where("measure_code is not null and name is not null").groupBy(_trim(F.col("pmid")).alias("pmid"), "name").agg(F.min_by("unit", rank).alias("unit"), F.min_by("measure_code", F.col("outcome_row_id")).alias("measure_code"))
    effects = stated.join(per_outcome, ["pmid", "name"]).select("claim_row_id", "text", "unit", "measure_code")

    def memo(f: Callable) -> Callable:
        kept: dict = {}

        def call(*args):
            if args not in kept:
                if len(kept) >= MEMO:
                    kept.clear()
                kept[args] = f(*args)
            return kept[args]

        return call

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["claim_row_id", "field", "common_unit", "value_milli"])

    def read_doses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(table)
        dose, duration = memo(lambda v, u: read_dose(v, u, g)), memo(lambda t: read_duration(t, g))
        for b in batches:
            rows = []
            for i, v, u, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if got := dose(v, u):
                    rows.append((i, "dose", *got))
                if got := duration(t):
                    rows.append((i, "duration", *got))
            yield emit(rows)

    def read_effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(table)
        effect = memo(lambda t, u, m: read_effect(t, u, *known.get(m, (None, None)), g))
        for b in batches:
            yield emit([(i, "effect_size", *got) for i, t, u, m in zip(*(c.to_pylist() for c in b.columns), strict=True) if (got := effect(t, u, m))])

    return doses.mapInArrow(read_doses, OUT).unionByName(effects.mapInArrow(read_effects, OUT))
