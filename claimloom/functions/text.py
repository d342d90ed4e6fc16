"""String expressions: normalisers, validators, tokenisers, sentence splits and extraction by pattern."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom import lexicons as L

SPACE = r"[\s\x{a0}]"


def let(c: Column, *steps) -> Column:
    """Apply functions one after the other, each to the last one's value. Every value is worked out once, where nested conditions would repeat it in each branch."""
    for f in steps:
        c = F.get(F.transform(F.array(c), f), F.lit(0))
    return c


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def norm(c: Column) -> Column:
    """Trimmed, lower case, spaces and hyphens as underscores; null as empty."""
    return F.translate(F.lower(strip(F.coalesce(c, F.lit("")))), " -", "__")


def contains_any(c: Column, terms: Sequence[str]) -> Column:
    """One search instead of a chain: terms that contain others are left out, the rest share their beginnings in one pattern."""
    least = [t for t in dict.fromkeys(terms) if not any(o != t and o in t for o in terms)]
    return c.rlike(_pattern(least)) if least else F.lit(False)


def _pattern(terms: Sequence[str]) -> str:
    """A pattern for any of the terms, factored by their first letters."""
    by: dict[str, list[str]] = {}
    for t in terms:
        by.setdefault(t[0], []).append(t[1:])
    parts = [_quoted(k) + ("" if "" in v else _quoted(v[0]) if len(v) == 1 else _pattern(v)) for k, v in by.items()]
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def _quoted(t: str) -> str:
    return "".join("\\" + x if x in r"\.[]{}()*+-?^$|" else x for x in t)


def lookup(c: Column, table: dict[str, Sequence[str]]) -> Column:
    """The key under which a value is listed, else null."""
    return F.create_map(*[F.lit(x) for key, values in table.items() for v in values for x in (v, key)])[c]


def effect_direction(c: Column, synonyms: dict[str, Sequence[str]] = L.EFFECT_SYNONYMS) -> Column:
    return let(norm(c), lambda n: F.coalesce(lookup(n, synonyms), F.when(n.isin(*L.EFFECT_DIRECTIONS), n), F.lit("unclear")))


def health_interpretation(c: Column, synonyms: dict[str, Sequence[str]] = L.HEALTH_SYNONYMS) -> Column:
    return let(norm(c), lambda n: F.coalesce(lookup(n, synonyms), F.when(n.isin(*L.HEALTH_INTERPRETATIONS), n), F.lit("unclear")))


def inferred_health(effect: Column, outcome: Column, adverse: Sequence[str] = L.ADVERSE_OUTCOMES, beneficial: Sequence[str] = L.BENEFICIAL_OUTCOMES) -> Column:
    """What a measured direction means for health; an adverse outcome's marker goes before a beneficial one's."""
    o = norm(outcome)
    bad, good = contains_any(o, adverse), contains_any(o, beneficial)
    return (
        F.when(effect == "no_significant_effect", "neutral")
        .when(bad & (effect == "decreased"), "beneficial")
        .when(bad & (effect == "increased"), "harmful")
        .when(good & (effect == "increased"), "beneficial")
        .when(good & (effect == "decreased"), "harmful")
        .otherwise("unclear")
    )


def claim_direction(value: Column, effect: Column, health: Column, outcome: Column) -> Column:
    """positive, negative, neutral, or empty where nothing says which."""
    meant = F.when((health == "unclear") & (F.coalesce(outcome, F.lit("")) != ""), inferred_health(effect, outcome)).otherwise(health)
    return (
        F.when((effect == "no_significant_effect") | (health == "neutral"), "neutral")
        .when(meant == "beneficial", "positive")
        .when(meant == "harmful", "negative")
        .otherwise(F.coalesce(lookup(norm(value), L.DIRECTION_SYNONYMS), F.lit("")))
    )


def subject_type(subject: Column, kind: Column, in_scope: Sequence[str] = L.IN_SCOPE_SUBJECTS) -> Column:
    def of(x: Column) -> Column:
        s, k = x["s"], x["k"]
        compound = contains_any(s, L.COMPOUND_MARKERS)
        prefixed = s.rlike("^(?:" + "|".join(L.STRAIN_PREFIXES) + ")")
        return (
            F.when(prefixed & ~compound, "strain")
            .when((k == "strain") & compound, "food")
            .when(k.isin("strain", "food"), k)
            .when(k.isin(*L.INTERVENTION_TYPES), "food")
            .when(contains_any(s, in_scope), "food")
            .otherwise(F.when(k != "", k).otherwise("food"))
        )

    return let(F.struct(norm(subject).alias("s"), norm(kind).alias("k")), of)


def subject_in_scope(subject: Column, kind: Column, in_scope: Sequence[str] = L.IN_SCOPE_SUBJECTS, out: Sequence[str] = L.OUT_OF_SCOPE_SUBJECTS) -> Column:
    s = norm(subject)
    return ~contains_any(s, out) & ((F.coalesce(kind, F.lit("")) == "strain") | contains_any(s, in_scope))


def claim_in_scope(subject: Column, kind: Column, outcome: Column, out: Sequence[str] = L.OUT_OF_SCOPE_OUTCOMES) -> Column:
    return subject_in_scope(subject, kind) & ~contains_any(norm(outcome), out)


def is_no_result(c: Column, phrases: Sequence[str] = L.NON_RESULT_PHRASES) -> Column:
    """Aim, method or background rather than a result."""
    return contains_any(F.lower(F.coalesce(c, F.lit(""))), phrases)


def sample_of_full_text(methods: Column, body: Column, patterns: Sequence[str] = L.FULL_TEXT_SAMPLE_PATTERNS) -> Column:
    """The sample size a full text states: the first pattern that gives a number, in the methods or, without them, in the whole body."""
    t = F.coalesce(F.nullif(methods, F.lit("")), body, F.lit(""))
    return F.coalesce(*[F.nullif(F.regexp_extract(t, "(?i)" + p, 1), F.lit("")).try_cast("bigint") for p in patterns])


def aliases_of(name: Column, known: dict[str, str] = L.ALIAS_RULES) -> Column:
    """A name and the other spelling it is known under, in order."""
    other = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[F.lower(name)]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(name, other))))


def direction_phrase(direction: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in L.DIRECTION_PHRASES.items() for x in kv])[direction], F.concat(F.lit("a "), direction, F.lit(" reported effect")))


def prompt_parts(c: Column, mark: str = "---") -> Column:
    """What stands before and after the first mark of a prompt; without one all of it is the second part."""
    parts = F.split(c, mark, 2)
    return F.struct(F.when(F.size(parts) > 1, strip(parts[0])).otherwise("").alias("system"), strip(F.when(F.size(parts) > 1, parts[1]).otherwise(parts[0])).alias("user"))


def score_band(score: Column, width: int = 5) -> Column:
    """The band of a score, such as 85-89; negative scores floor downwards."""
    low = (F.floor(score / width) * width).cast("int")
    return F.concat(low.cast("string"), F.lit("-"), (low + width - 1).cast("string"))


def study_type(title: Column, abstract: Column, given: Column) -> Column:
    t, a = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(abstract, F.lit("")))
    text = F.concat(t, F.lit("\n"), a)
    return (
        F.when(contains_any(text, L.REVIEW_MARKERS) | text.contains(" review") | t.endswith("review"), "review")
        .when(contains_any(text, L.PRIMARY_MARKERS), F.when(text.contains("crossover"), "Crossover trial").otherwise("RCT"))
        .when(F.lower(F.coalesce(given, F.lit(""))).isin("review", "meta-analysis/review"), "review")
        .otherwise(given)
    )


def claim_id(subject: Column, outcome: Column, direction: Column) -> Column:
    return F.substring(F.md5(F.concat(F.lower(subject), F.lit("|"), F.lower(outcome), F.lit("|"), direction)), 1, 12)


def claim_text(subject: Column, outcome: Column, direction: Column) -> Column:
    return F.concat(subject, F.lit(" has "), direction, F.lit(" effect on "), outcome)


def clean_format(c: Column) -> Column:
    """Runs of white space and underscores as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, rf"(?:{SPACE}|_)+", "_"), "^_+|_+$", "")


def food_name(c: Column) -> Column:
    """A food's canonical spelling: synonyms in order, then special cases in order, then the format."""
    def synonym(a: str, b: str):
        return lambda s: F.when((s == a) | F.startswith(s, F.lit(a + " ")), F.concat(F.lit(b), F.substring(s, len(a) + 1, 1 << 30))).otherwise(s)

    def becomes(test, name: str):
        return lambda s: F.when(test(s), name).otherwise(s)

    has = lambda x: lambda s: F.contains(s, F.lit(x))
    heat_killed = "heat-killed lactobacillus paracasei k71"
    return let(
        F.lower(strip(F.coalesce(c, F.lit("")))),
        *[synonym(a, b) for a, b in L.FOOD_SYNONYMS],
        lambda s: F.regexp_replace(F.regexp_replace(s, r"\s*\(?3\.25%\s*fat\)?", ""), r"\s*\((?:dy|dcy|py)\)\s*$", ""),
        lambda s: F.replace(s, F.lit("vitamin d + calcium-fortified yogurt drink"), F.lit("vitamin d calcium fortified yogurt drink")),
        lambda s: F.replace(s, F.lit("vitamin d- or vitamin d + calcium-fortified yogurt drink"), F.lit("vitamin d fortified yogurt drink")),
        becomes(lambda s: has(heat_killed)(s) | s.isin("lab diet", "lab diet group"), heat_killed + " supplement"),
        becomes(lambda s: has("greek yogurt")(s) & s.rlike(r"exercise|training|\+"), "greek yogurt"),
        becomes(lambda s: has("lactobacillus rhamnosus gr-1")(s) & s.rlike("yogurt|yoghurt"), "probiotic yogurt"),
        becomes(lambda s: s.rlike("^probiotic[_ ]yogurt containing"), "probiotic yogurt"),
        becomes(lambda s: has("bacillus coagulans")(s) & has("inulin")(s), "synbiotic supplement"),
        becomes(lambda s: s.rlike("with greek yogurt|greek yogurt consumption"), "greek yogurt"),
        becomes(lambda s: s.rlike("^(?:combination of bifidobacterium|multi-strain probiotic|multi-strain combination)"), "multi strain probiotic formulation"),
        becomes(lambda s: F.startswith(s, F.lit("yogurt containing")), "probiotic yogurt"),
        becomes(lambda s: F.startswith(s, F.lit("yeast containing saccharomyces cerevisiae")), "saccharomyces cerevisiae yeast"),
        lambda s: clean_format(F.replace(s, F.lit("probiotic/synbiotic"), F.lit("probiotic synbiotic"))),
    )


def food_is_valid(normalized: Column) -> Column:
    """Whether a normalised name can be a food."""
    spaced = F.replace(normalized, F.lit("_"), F.lit(" "))
    bad = normalized.isin(*L.INVALID_FOODS) | spaced.isin(*L.INVALID_FOODS)
    for p in L.INVALID_FOOD_PATTERNS:
        bad = bad | normalized.rlike("(?i)" + p) | spaced.rlike("(?i)" + p)
    return ~bad & (F.length(normalized) > 2)


def is_suspicious_food(c: Column) -> Column:
    s = F.lower(strip(F.coalesce(c, F.lit(""))))
    return reduce(lambda a, b: a | b, [s.rlike(p) for p in L.SUSPICIOUS_FOOD_PATTERNS])


def is_over_specific(c: Column) -> Column:
    s = F.lower(strip(F.coalesce(c, F.lit(""))))
    return (F.length(s) - F.length(F.replace(s, F.lit("_"), F.lit(""))) >= 4) | s.rlike(r"\p{Nd}")


def strain_name(c: Column) -> Column:
    """Single spaces, genera in their case wherever they stand, the first word capitalised, the second in lower case."""
    s = F.array_join(F.filter(F.split(F.coalesce(c, F.lit("")), rf"{SPACE}+"), lambda x: x != ""), " ")
    for g in L.GENERA:
        s = F.regexp_replace(s, "(?i)" + g.lower(), g)

    def cased(w: Column) -> Column:
        first = F.concat(F.upper(F.substring(w[0], 1, 1)), F.lower(F.substring(w[0], 2, 1 << 30)))
        many = F.concat_ws(" ", first, F.lower(F.get(w, F.lit(1))), F.array_join(F.slice(w, F.lit(3), F.greatest(F.size(w) - 2, F.lit(0))), " "))
        return F.when(F.size(w) < 2, first).otherwise(F.rtrim(many))

    return let(F.split(s, " "), cased)


def strain_is_valid(c: Column) -> Column:
    low = F.lower(strip(F.coalesce(c, F.lit(""))))
    shaped = let(strain_name(c), lambda n: reduce(lambda a, b: a | b, [n.rlike(p) for p in L.STRAIN_PATTERNS]) & (F.length(n) >= 5) & ~n.rlike(r"[\x{4e00}-\x{9fff}]"))
    return (low != "") & ~contains_any(low, L.STRAIN_BLACKLIST) & shaped


def strain_parts(c: Column) -> Column:
    """genus, species, subspecies and strain of a name, by the place of its words."""
    w = F.split(F.trim(c), r"\s+")
    sub = F.array_position(F.transform(w, lambda x: F.lower(x)), "subsp.").cast("int")
    rest = lambda i: F.nullif(F.array_join(F.slice(w, i, F.greatest(F.size(w) - i + 1, F.lit(0))), " "), F.lit(""))
    return F.struct(
        F.regexp_replace(w[0], r"\.$", "").alias("genus"),
        F.get(w, F.lit(1)).alias("species"),
        F.when(sub > 0, F.get(w, sub)).alias("subspecies"),
        F.when(sub > 0, rest(sub + 2)).otherwise(rest(F.lit(3))).alias("strain"),
    )


def action(c: Column) -> Column:
    """One of the supported edit actions."""
    a = F.translate(F.lower(strip(c)), " -", "__")
    out = F.when(a.contains("manual_review"), "preserve").when(a.isin("no_op", "noop"), "no_change")
    out = out.when(a.rlike("update_type|retype|change_type"), "retype").when(a.rlike("delete_orphan|remove_orphan"), "delete_orphan")
    out = out.when(a.rlike("out_of_scope|domain_drift"), "mark_out_of_scope").when(a.rlike("set_name|display_name|title_case"), "set_name").when(a.rlike("^(?:delete|remove)"), "delete")
    for x in ("merge", "rename", "normalize", "preserve", "no_change"):
        out = out.when(a.startswith(x), x)
    return out.otherwise("skip")


def bag(c: Column) -> Column:
    """All words of letters and digits, repeated ones too."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def content_words(c: Column, stopwords: Sequence[str] = L.STOPWORDS) -> Column:
    """Distinct words of three letters or more, without stop words."""
    w = F.regexp_extract_all(F.translate(F.lower(F.coalesce(c, F.lit(""))), "_-/", "   "), F.lit("[a-z][a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(w, lambda x: (F.length(x) >= 3) & ~x.isin(*stopwords)))


def name_words(c: Column) -> Column:
    """Distinct parts of a name between characters that are no letters or digits."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "_"), "_"), lambda x: x != ""))


def sentences(c: Column) -> Column:
    """Split after an end mark where a capital follows."""
    return F.split(strip(c), r"(?<=[.!?])\s+(?=[A-Z])")


def snippet_sentences(c: Column, least: int = 25) -> Column:
    """Split where a capital, digit or bracket follows; short ones are dropped. White space is collapsed first."""
    flat = strip(F.regexp_replace(F.coalesce(c, F.lit("")), rf"{SPACE}+", " "))
    return F.filter(F.split(flat, r"(?<=[.!?])\s+(?=[A-Z0-9(])"), lambda x: F.length(F.trim(x)) >= least)


def p_value(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?i)P\s*[=<>]\s*0?\.\d+", 0), F.lit(""))


def largest_sample(c: Column, patterns: Sequence[str] = L.SAMPLE_SIZE_PATTERNS) -> Column:
    """The largest number under 100,000 of the first pattern that has one; 0 without."""
    found = [F.array_max(F.filter(F.transform(F.regexp_extract_all(c, F.lit("(?i)" + p), F.lit(1)), lambda x: x.try_cast("bigint")), lambda x: x < 100_000)) for p in patterns]
    return F.coalesce(*found, F.lit(0).cast("bigint"))


def first_sample(c: Column, patterns: Sequence[str] = L.RULE_SAMPLE_PATTERNS) -> Column:
    """The number of the first pattern that applies, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(F.lower(c), p, 1), F.lit("")).try_cast("bigint") for p in patterns])


def duration_days(c: Column) -> Column:
    """Days of the first duration: weeks by 7, months by 30. A unit that is only abbreviated is passed over."""
    patterns = [rf"(?i)(?:for|over|during)\s+(\d+)\s*(?:{u})" for u in ("weeks?|wk", "months?|mo", "days?|d")]
    patterns += [rf"(?i){w}\s+(?:period|duration)\s*:?\s*(\d+)\s*(?:week|month|day)" for w in ("intervention", "treatment", "study")]
    patterns += [rf"(?i)(\d+)\s*(?:{u})" for u in ("weeks?|wk", "months?|mo", "days?|d")]
    out = []
    for p in patterns:
        whole, n = F.lower(F.regexp_extract(c, p, 0)), F.regexp_extract(c, p, 1).try_cast("bigint")
        out.append(F.when(whole.contains("week"), n * 7).when(whole.contains("month"), n * 30).when(whole.contains("day"), n))
    return F.coalesce(*out)


def dose(c: Column) -> Column:
    """value, unit and frequency of the first dose."""
    def hit(p: str, value, unit) -> Column:
        whole = F.regexp_extract(c, p, 0)
        daily = F.when(F.lower(whole).contains("day"), "daily")
        return F.when(whole != "", F.struct(value(p).alias("value"), unit(p).alias("unit"), daily.alias("frequency")))

    one = lambda p: F.replace(F.regexp_extract(c, p, 1), F.lit(","), F.lit("")).try_cast("double")
    power = r"(?i)(\d+(?:\.\d+)?)\s*(?:\x{d7}|x|\*)?\s*10\^?(\d+)\s*(?:CFU|cfu)(?:/day)?"
    whole = F.regexp_extract(c, power, 0)
    first = F.when(whole != "", F.struct((one(power) * F.pow(F.lit(10.0), F.regexp_extract(c, power, 2).try_cast("double"))).alias("value"), F.lit("CFU/day").alias("unit"), F.lit("daily").alias("frequency")))
    rest = [hit(p, one, lambda p: F.lit("CFU")) for p in (r"(?i)(\d{1,3}(?:,\d{3})+)\s*(?:CFU|cfu)", r"(?i)(\d{10,})\s*(?:CFU|cfu)")]
    weight = [r"(?i)(\d+(?:\.\d+)?)\s*(g|mg|mcg)\s*(?:per|/)\s*(day|d)", r"(?i)(\d+(?:\.\d+)?)\s*(g|mg|ml|capsules?|tablets?)\s*(?:daily|per day|/day)?"]
    rest += [hit(p, one, lambda p: F.regexp_extract(c, p, 2)) for p in weight]
    return F.coalesce(first, *rest)


def cited_pmids(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\bPMID[:\s]*(\d{6,9})\b"), F.lit(1))))


def cited_claims(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b[0-9a-f]{12}\b"), F.lit(0))))


def json_object(c: Column) -> Column:
    """The JSON object of an answer: a fenced one first, else from the first brace to the last; null if neither parses."""
    fenced = F.nullif(F.regexp_extract(c, r"(?s)```json\s*(\{.*?\})\s*```", 1), F.lit(""))
    outer = F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))
    return F.coalesce(*[F.when(F.try_parse_json(x).isNotNull(), x) for x in (fenced, outer)])


def abstains(c: Column) -> Column:
    return contains_any(F.lower(F.coalesce(c, F.lit(""))), L.ABSTENTION_MARKERS)


def masked(c: Column) -> Column:
    return F.when(F.length(c) <= 8, "*" * 8).otherwise(F.concat(F.substring(c, 1, 4), F.lit("..."), F.substring(c, -4, 4)))


def node_id(kind: Column, name: Column) -> Column:
    return F.concat(kind, F.lit("_"), name)


def as_fraction(c: Column) -> Column:
    """Confidences given in percent."""
    return F.when(c > 1, c / 100).otherwise(c)
