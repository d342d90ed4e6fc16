"""Reading quantities: numbers as people write them, and unit strings segmented over tries of prefixes, roots and exponents.

``segment`` runs a dynamic programme over the positions of a unit string. From every position it follows the tries of prefixes
and roots, then reads an exponent, and keeps all readings of the rest; ``read_unit`` scores the readings of the whole string
(letters in the wrong case, rare prefixes, missing separators) and adds a prior for the dimension the field is expected to have,
so that "m" is a metre for a girth, "mM" a concentration and "MG/DL" milligrams.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import lru_cache

Dim = tuple[tuple[str, int], ...]

#: Powers of ten by symbol and by name, with the penalty of a prefix that clinical units rarely bear. Fixed values.
PREFIXES = {
    "k": (1e3, 0.0), "kilo": (1e3, 0.0), "d": (1e-1, 0.0), "deci": (1e-1, 0.0), "c": (1e-2, 0.0), "centi": (1e-2, 0.0), "m": (1e-3, 0.0), "milli": (1e-3, 0.0),
    "u": (1e-6, 0.0), "µ": (1e-6, 0.0), "mc": (1e-6, 0.5), "micro": (1e-6, 0.0), "n": (1e-9, 0.0), "nano": (1e-9, 0.0), "p": (1e-12, 0.0), "pico": (1e-12, 0.0),
    "h": (1e2, 3.0), "hecto": (1e2, 1.0), "M": (1e6, 4.0), "mega": (1e6, 1.0), "G": (1e9, 6.0), "giga": (1e9, 1.0), "f": (1e-15, 3.0), "femto": (1e-15, 1.0),
}
#: Roots: scale in base units (g, L, mol, m, Pa, day, CFU, J) and dimension; symbols keep their case, names have none. Fixed values.
SYMBOLS = {
    "g": (1.0, {"g": 1}), "l": (1.0, {"L": 1}), "L": (1.0, {"L": 1}), "mol": (1.0, {"mol": 1}), "M": (1.0, {"mol": 1, "L": -1}), "m": (1.0, {"m": 1}), "Pa": (1.0, {"Pa": 1}),
    "J": (1.0, {"J": 1}), "d": (1.0, {"day": 1}), "cc": (1e-3, {"L": 1}), "%": (10.0, {"L": -1}),
}
NAMES = {
    "gram": (1.0, {"g": 1}), "grams": (1.0, {"g": 1}), "gramme": (1.0, {"g": 1}), "grammes": (1.0, {"g": 1}), "gr": (1.0, {"g": 1}), "gm": (1.0, {"g": 1}), "gs": (1.0, {"g": 1}),
    "litre": (1.0, {"L": 1}), "litres": (1.0, {"L": 1}), "liter": (1.0, {"L": 1}), "liters": (1.0, {"L": 1}), "mole": (1.0, {"mol": 1}), "moles": (1.0, {"mol": 1}), "molar": (1.0, {"mol": 1, "L": -1}),
    "metre": (1.0, {"m": 1}), "metres": (1.0, {"m": 1}), "meter": (1.0, {"m": 1}), "meters": (1.0, {"m": 1}), "pascal": (1.0, {"Pa": 1}), "pascals": (1.0, {"Pa": 1}), "joule": (1.0, {"J": 1}), "joules": (1.0, {"J": 1}),
    "day": (1.0, {"day": 1}), "days": (1.0, {"day": 1}), "cfu": (1.0, {"CFU": 1}), "cfus": (1.0, {"CFU": 1}), "c.f.u": (1.0, {"CFU": 1}), "colony forming units": (1.0, {"CFU": 1}), "colony forming unit": (1.0, {"CFU": 1}), "colony-forming units": (1.0, {"CFU": 1}),
}
#: Ways to write the units whose factors a table gives. Fixed values.
SPELLINGS = {
    "oz": ("oz", "ounce", "ounces"), "lb": ("lb", "lbs", "pound", "pounds"), "in": ("in", "inch", "inches"), "ft": ("ft", "foot", "feet"), "st": ("st", "stone", "stones"),
    "mmHg": ("mmhg", "mm hg", "mm of hg", "mm of mercury"), "Torr": ("torr",), "week": ("week", "weeks", "wk", "wks", "w"), "month": ("month", "months", "mo", "mos"), "year": ("year", "years", "yr", "yrs", "y"), "kcal": ("kcal", "kilocalorie", "kilocalories"),
}
SUPERSCRIPT = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻", "0123456789+-")
NUMBER_WORDS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())}
MULTIPLES = {"hundred": 1e2, "thousand": 1e3, "million": 1e6, "mio": 1e6, "billion": 1e9, "bn": 1e9, "trillion": 1e12}

_SEPARATOR = re.compile(r"\s*(/|\bper\b|·|\*|⋅|×)\s*|\s+|\.(?=\s|$|[/·*])\s*|\.$", re.I)
_EXPONENT = re.compile(r"\^?\s?([-+−⁻⁺]?[\d⁰¹²³⁴⁵⁶⁷⁸⁹])")


def _dim(d: dict[str, int]) -> Dim:
    return tuple(sorted((k, v) for k, v in d.items() if v))


class Trie:
    """Keys by their characters; ``walk`` gives all keys that a text has at a position, longest last."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, key: str, value: object) -> None:
        node = self.root
        for c in key:
            node = node.setdefault(c, {})
        node[""] = value

    def walk(self, text: str, at: int):
        node = self.root
        for i in range(at, len(text)):
            node = node.get(text[i])
            if node is None:
                return
            if "" in node:
                yield i + 1, node[""]


@dataclass(frozen=True)
class Reading:
    scale: float
    dim: Dim
    penalty: float


MOST_FACTORS = 12


@dataclass
class Grammar:
    """The tries, with roots from a table of unit constants: rows of unit, base_unit, factor."""

    constants: tuple[tuple[str, str, float], ...] = ()
    prefixes: Trie = field(default_factory=Trie)
    roots: Trie = field(default_factory=Trie)

    def __post_init__(self) -> None:
        by: dict[str, list] = {}
        for p, (scale, penalty) in PREFIXES.items():
            by.setdefault(p.lower(), []).append((p, scale, penalty))
        for low, forms in by.items():
            self.prefixes.add(low, forms)
        roots: dict[str, list] = {}
        for s, (scale, dim) in SYMBOLS.items():
            roots.setdefault(s.lower(), []).append((s, scale, dim, s not in ("%", "cc", "d")))
        for s, (scale, dim) in NAMES.items():
            roots.setdefault(s, []).append((None, scale, dim, s not in ("day", "days")))
        for low, forms in roots.items():
            self.roots.add(low, forms)
        added: dict[str, list] = {}
        for unit, base, factor in self.constants:
            got = read_unit(base, None, self)
            if got:
                for s in SPELLINGS.get(unit, (unit.lower(),)):
                    added.setdefault(s, []).append((None, got.scale * factor, dict(got.dim), False))
        for low, forms in added.items():
            self.roots.add(low, roots.get(low, []) + forms)
        self._cached = lru_cache(100_000)(self._read)

    def atoms(self, text: str, low: str, at: int) -> list[tuple[int, float, dict[str, int], float]]:
        """All of prefix, root and exponent that can stand at a position: end, scale, dimension, penalty."""
        starts = [(at, 1.0, 0.0, False)]
        for end, forms in self.prefixes.walk(low, at):
            for p, scale, penalty in forms:
                starts.append((end, scale, penalty + (sum(a != b for a, b in zip(p, text[at:end], strict=True)) if len(p) <= 2 else 0), True))
        out = []
        for mid, scale, penalty, prefixed in starts:
            for end, forms in self.roots.walk(low, mid):
                for symbol, size, dim, may_bear in forms:
                    if prefixed and not may_bear:
                        continue
                    cost = penalty + (0.0 if symbol is None else sum(a != b for a, b in zip(symbol, text[mid:end], strict=True)))
                    out.append((end, scale * size, dim, cost))
                    if (m := _EXPONENT.match(text, end)) and not (m[1][-1].isdigit() and text[m.end() : m.end() + 1].isdigit()):
                        k = int(m[1].translate(SUPERSCRIPT).replace("−", "-"))
                        if k:
                            out.append((m.end(), (scale * size) ** k, {u: v * k for u, v in dim.items()}, cost))
        return out

    def segment(self, text: str) -> list[Reading]:
        """All readings of a unit string of any length. A unit of more than ``MOST_FACTORS`` factors is none, so the readings of the rest of a string stay few."""
        low, n = text.lower(), len(text)
        if len(low) != n:
            return []
        rest: list[dict[bool, dict[tuple[float, Dim], float]]] = [{} for _ in range(n + 1)]
        rest[n] = {False: {(1.0, ()): 0.0}}
        factors = [0] * (n + 1)  # the fewest a reading from here has
        for at in range(n - 1, -1, -1):
            few = MOST_FACTORS
            for under in (False, True):
                got: dict[tuple[float, Dim], float] = {}
                for end, scale, dim, cost in self.atoms(text, low, at):
                    sign = -1 if under else 1
                    follow = []
                    if end == n:
                        follow.append((n, False, 0.0))
                    else:
                        m = _SEPARATOR.match(text, end)
                        if m and m.end() > end:
                            follow.append((m.end(), (m[1] or "").lower() in ("/", "per"), 0.0))
                        follow.append((end, False, 1.0 + (not text[end - 1].isdigit())))
                    for nxt, divide, extra in follow:
                        if factors[nxt] >= MOST_FACTORS or divide not in rest[nxt]:
                            continue
                        few = min(few, factors[nxt] + 1)
                        for (s, d), c in (rest[nxt].get(divide) or {}).items():
                            total = dict(d)
                            for u, v in dim.items():
                                total[u] = total.get(u, 0) + v * sign
                            key = (float(f"{s * scale**sign:.12g}"), _dim(total))
                            new = c + cost + extra
                            if new < got.get(key, math.inf):
                                got[key] = new
                if got:
                    rest[at][under] = got
            factors[at] = few
        return [Reading(s, d, c) for (s, d), c in (rest[0].get(False) or {}).items()]

    def read(self, text: str, expected: tuple[Dim, ...] | None) -> Reading | None:
        return self._cached(text, expected)

    def _read(self, text: str, expected: tuple[Dim, ...] | None) -> Reading | None:
        return read_unit(text, expected, self)


def read_unit(text: str, expected: tuple[Dim, ...] | None, grammar: Grammar) -> Reading | None:
    """The best reading of a unit string; with ``expected`` only one of those dimensions, the earlier the more likely."""
    clean = re.sub(r"\s+", " ", text.replace("μ", "µ").replace("​", "")).strip().strip(",;:").strip()
    if not clean:
        return None
    readings = grammar.segment(clean)
    if expected is not None:
        readings = [Reading(r.scale, r.dim, r.penalty + 0.4 * expected.index(r.dim)) for r in readings if r.dim in expected]
    return min(readings, key=lambda r: (r.penalty, abs(math.log10(r.scale)), r.dim), default=None)


_PLAIN = r"\d{1,3}(?:,\d{3})+(?!\d)(?:\.\d+)?|\d+(?:[.,]\d+)?|[.,]\d+"
_POWER = re.compile(rf"(?P<a>{_PLAIN})?\s*(?:[x×*·]\s*)?10\s*(?:\^|\*\*)?\s*(?P<e>[-+−]?\d{{1,2}}|[⁻⁺]?[⁰¹²³⁴⁵⁶⁷⁸⁹]{{1,2}})(?!\d)")
_CARET = re.compile(r"(?:^|[x×*·]\s*)10\s*(?:\^|\*\*)\s*[-+−]?\d|(?:^|[x×*·]\s*)10[⁻⁺]?[⁰¹²³⁴⁵⁶⁷⁸⁹]")
_FLOAT = re.compile(r"(\d+(?:\.\d+)?)[eE]([-+]?\d{1,2})(?![\w.])")
_NUMBER = re.compile(rf"(?:{_PLAIN})")


def plain_number(s: str) -> float:
    """Digits with a decimal point or comma, or with commas between groups of three. A comma after a lone zero is decimal."""
    if re.fullmatch(r"[1-9]\d{0,2}(?:,\d{3})+(?:\.\d+)?", s):
        return float(s.replace(",", ""))
    if s.count(",") == 1 and "." not in s:
        return float(s.replace(",", "."))
    return float(s.replace(",", ""))


def leading_number(text: str) -> tuple[float, str] | None:
    """The number a text begins with and the rest: powers of ten, logarithms, multiples in words, number words. A range is none."""
    t = text.strip()
    if _CARET.match(t) or ((m := _NUMBER.match(t)) and _CARET.match(t[m.end() :].lstrip())):
        m = _POWER.match(t)
        if m:
            a = plain_number(m["a"]) if m["a"] else 1.0
            return float(f"{a}e{int(m['e'].translate(SUPERSCRIPT).replace('−', '-'))}"), t[m.end() :]
    if m := _FLOAT.match(t):
        return float(f"{m[1]}e{m[2]}"), t[m.end() :]
    if m := _NUMBER.match(t):
        rest = t[m.end() :]
        if re.match(r"\s*(?:-|–|—|to)\s*\d", rest):
            return None
        value = plain_number(m[0])
        if g := re.match(r"\s*log(?:10|₁₀)?\b\s*", rest):
            return 10.0**value, rest[g.end() :]
        if g := re.match(r"\s*(" + "|".join(MULTIPLES) + r")\b", rest, re.I):
            return float(f"{value * MULTIPLES[g[1].lower()]:.15g}"), rest[g.end() :]
        return value, rest
    if (m := re.match(r"([a-z]+)\b", t, re.I)) and m[1].lower() in NUMBER_WORDS:
        return float(NUMBER_WORDS[m[1].lower()]), t[m.end() :]
    return None
