"""Quantities: readings of units and numbers, conversions there and back, and hostile inputs."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimloom.functions.unit_grammar import Grammar, leading_number, plain_number
from claimloom.operators import quantities as Q

CONSTANTS = (("oz", "g", 28.349523), ("lb", "kg", 0.453592), ("in", "cm", 2.54), ("mmHg", "Pa", 133.322), ("Torr", "Pa", 133.322), ("st", "kg", 6.350293), ("week", "day", 7.0), ("month", "day", 30.0), ("year", "day", 365.0), ("ft", "cm", 30.48))
G = Grammar(CONSTANTS)


@pytest.mark.parametrize(
    ("text", "number"),
    [("4 x 10^8 CFU", 4e8), ("2.5×10¹¹ cfu", 2.5e11), ("10^9", 1e9), ("1.5e6 CFU", 1.5e6), ("9.0 log10 cfu", 1e9), ("10 million", 1e7), ("1,500,000", 1.5e6), ("12,5 cL", 12.5), ("0,150 kg", 0.15), ("0,0035 kg", 0.0035), (",35 x", 0.35), ("twelve weeks", 12), ("2-3 portions", None), ("high dose", None)],
)
def test_numbers(text, number):
    got = leading_number(text)
    assert (got[0] if got else None) == (pytest.approx(number) if number is not None else None)


@pytest.mark.parametrize(
    ("value", "unit", "expected"),
    [
        ("200", "gram/d", ("mg/day", 200_000_000)), ("0.21 L t.i.d.", None, ("mL/day", 630_000)), ("10^10", "CFU per week", ("CFU/day", 1428571428571)), ("3", "tablets", None), (None, None, None), ("", "", None),
        ("64 million colony forming units", "/d", ("CFU/day", 64_000_000_000)), ("125", "cc 2x/day", ("mL/day", 250_000)), ("5", "gr.", ("mg/day", 5_000_000)), ("500,000 µg", None, ("mg/day", 500_000)), ("2 capsules/day", None, None), ("1 oz", "every other day", ("mg/day", 14174762)),
    ],
)
def test_doses(value, unit, expected):
    assert Q.read_dose(value, unit, G) == expected


@pytest.mark.parametrize(("text", "days"), [("12w", 84), ("for 6 weeks", 42), ("1 mos.", 30), ("8-week", 56), ("ten weeks", 70), ("2 y", 730), ("NR", None), (None, None), ("21-day", 21)])
def test_durations(text, days):
    got = Q.read_duration(text, G)
    assert (got and got[1]) == (days and days * 1000)


@pytest.mark.parametrize(
    ("text", "unit", "common", "mass", "expected"),
    [
        ("MD -40.3 mg/dl", None, "mmol/L", 386.65, -1042), ("−498", "µmol/L", "mmol/L", 386.65, -498), ("−0.36 MMOL/L", "g/L", "mmol/L", 386.65, -360), ("23.7 mg %", None, "mmol/L", 386.65, 613), ("-1.26 kPa", None, "mmHg", None, -9451), ("Δ = -1.81 in, n = 78", None, "cm", None, -4597),
        ("492µM", None, "umol/L", 113.12, 492000), ("OR 0.8 (95% CI 0.6-1.0)", "mg/dl", "mmol/L", 386.65, None), ("-15.4%", "mg/dl", "mmol/L", 386.65, None), ("0.43", "score", "mmol/L", 386.65, None), ("0.43", None, "mmol/L", 386.65, None), ("11.3 (95% CI 4.5 to 18.2)", "ng/mL", "nmol/L", 400.64, 28205),
        ("-2.92kg (95% CI -4.68 to -1.17)", None, "kg", None, -2920), ("9.10 pg·mL⁻¹", None, "pg/mL", None, 9100), ("-354pg/dl", None, "pg/mL", None, -3540), ("mean difference -54.8mm", None, "cm", None, -5480), ("SMD -0.67", "kg", "kg", None, None), ("", "kg", "kg", None, None),
    ],
)
def test_effects(text, unit, common, mass, expected):
    got = Q.read_effect(text, unit, common, mass, G)
    assert (got and got[1]) == expected


def test_dimension_settles_what_letters_leave_open():
    metre, pressure, molar = ((("m", 1),),), ((("Pa", 1),),), ((("L", -1), ("mol", 1)),)
    assert G.read("m", metre).scale == 1.0
    assert G.read("mm", metre).scale == pytest.approx(1e-3)
    assert G.read("mM", molar).scale == pytest.approx(1e-3)
    assert G.read("mm of Hg", pressure).scale == pytest.approx(133.322)
    assert G.read("mM", metre).scale == pytest.approx(1e-3)
    assert G.read("furlong", metre) is None and G.read("", metre) is None and G.read("m" * 5000, metre) is None


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 9999), st.sampled_from(["k", "", "d", "c", "m", "µ", "n"]), st.sampled_from(["g", "L", "mol", "Pa"]), st.sampled_from([" ", ""]))
def test_prefixes_round_trip(n, prefix, root, gap):
    scale = {"k": 1e3, "": 1.0, "d": 0.1, "c": 0.01, "m": 1e-3, "µ": 1e-6, "n": 1e-9}[prefix]
    number, rest = leading_number(f"{n}{gap}{prefix}{root}")
    assert number == n and G.read(rest.strip(), (((root, 1),),)).scale == pytest.approx(scale)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40), st.one_of(st.none(), st.text(max_size=20)))
def test_no_text_breaks_the_reader(text, unit):
    Q.read_dose(text, unit, G)
    Q.read_duration(text, G)
    Q.read_effect(text, unit, "mmol/L", 100.0, G)


def test_plain_numbers():
    assert plain_number("1,234,567.5") == 1234567.5 and plain_number("0,375") == 0.375 and plain_number("4,2") == 4.2


def test_operator_on_small_tables(spark):
    claims = spark.createDataFrame([(1, " 7 ", "glucose", "18 mg/dL", ("5", "g daily", "2 wk"), "x"), (2, "7", "glucose", "0.5", None, "x"), (2, "7", "glucose", "0.5", None, "x"), (3, None, None, None, (None, None, None), None), (4, "8", "glucose", "0.5", ("1e30", "kg", None), "x")], "claim_row_id bigint, pmid string, object_name string, effect_size string, dose_info struct<value:string,unit:string,duration:string>, unit string")
    outcomes = spark.createDataFrame([(2, "7", "glucose", None, "GLU"), (3, "7", "glucose", "mM", "GLU")], "outcome_row_id bigint, pmid string, name string, unit string, measure_code string")
    measures = spark.createDataFrame([("GLU", "mmol/L", 180.0)], "measure_code string, common_unit string, molar_mass double")
    constants = spark.createDataFrame(list(CONSTANTS), "unit string, base_unit string, factor double")
    got = sorted(tuple(r) for r in Q.found(claims, outcomes, measures, constants).collect())
    assert got == [(1, "dose", "mg/day", 5_000_000), (1, "duration", "day", 14_000), (1, "effect_size", "mmol/L", 1000), (2, "effect_size", "mmol/L", 500), (2, "effect_size", "mmol/L", 500)]
    assert Q.found(claims.limit(0), outcomes.limit(0), measures.limit(0), constants.limit(0)).count() == 0


def test_unit_texts_of_any_length():
    """The old bound was 60 characters."""
    g = Grammar()
    long = "milligrams" + " " * 200 + "per" + " " * 200 + "day"
    assert g.read(long, None) == g.read("milligrams per day", None) is not None
    assert g.read("mg " * 50_000, None) is None and g.read("x" * 100_000, None) is None
