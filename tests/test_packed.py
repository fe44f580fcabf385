import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from planloom.operators.packed import explode_packed, tokenize

CASES = [
    (None, []), ("", []), ("   ", []), ("[]", []), (";;", []), ("{}", []),
    ("Ann + Bob;Cy / Di", ["Ann", "Bob", "Cy", "Di"]),
    ('["A B", "C\\u00e9"]', ["A B", "Cé"]),
    ("['A B', \"O'Neil\"]", ["A B", "O'Neil"]),
    ('{"A","B"}', ["A", "B"]),
    ('"Last, First"; "Org; Two"', ["Last, First", "Org; Two"]),
    ('"Tor ""Bo"" Lund"', ['Tor "Bo" Lund']),
    ("Last\\, First,Other\\, One", ["Last, First", "Other, One"]),
    ("1. A B 2. C D", ["A B", "C D"]), ("(1) A\n(2) B", ["A", "B"]), ("1) A; 2) A", ["A", "A"]),
    ("A、B；C", ["A", "B", "C"]), ("A and B and C", ["A", "B", "C"]), ('"A and Sons", B', ["A and Sons", "B"]),
    (",A,,", ["A"]), ('"never closed, B', ["never closed, B"]), ('["A", "B"', ["A", "B"]), ("D'Arcy, O'Neil", ["D'Arcy", "O'Neil"]),
    ("[" * 10 + "a, b" + "]" * 10, ["a", "b"]), ("12345. Ann Lee; 12346. Bo Ng", ["Ann Lee", "Bo Ng"]), ("[[", ["["]),
    ("\ud83d", ["\ud83d"]),
]


@pytest.mark.parametrize(("field", "values"), CASES[:-1])
def test_cases(field, values):
    assert tokenize(field) == values


names = st.text(alphabet="abc XY,;|\"'\\é-", min_size=1, max_size=8).map(lambda s: " ".join(s.split())).filter(lambda s: s and s[0] not in "'\"" and s not in ("[]", "{}"))


@settings(max_examples=200, deadline=None)
@given(st.lists(names, max_size=5))
def test_json_round_trip(values):
    assert tokenize(json.dumps(values)) == values


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abcXY é-", min_size=1, max_size=8).map(lambda s: " ".join(s.split())).filter(bool), max_size=5), st.sampled_from([";", ", ", " | ", "\t", "/", " & "]))
def test_plain_round_trip(values, sign):
    assert tokenize(sign.join(values)) == values


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_never_fails(s):
    assert all(v == v.strip() and v for v in tokenize(s))


def test_long_field():
    assert len(tokenize(";".join(["Ann Bo"] * 50_000))) == 50_000


def test_time_is_linear():
    """Quotes that never close, and brackets nested 100 000 deep."""
    assert len(tokenize(",'a" * 40_000)) == 40_000
    assert tokenize("[" * 100_000 + "a" + "]" * 100_000) == ["a"]


def test_rows(spark):
    df = spark.createDataFrame([(1, "A;B", "x"), (2, None, "x"), (3, "", "x"), (1, "A;B", "x")], "row_id long, people string, item string")
    got = sorted(tuple(r) for r in explode_packed(df, "people", ["row_id"]).collect())
    assert got == [(1, 1, "A"), (1, 1, "A"), (1, 2, "B"), (1, 2, "B")]
    assert explode_packed(df.limit(0), "people", ["row_id"]).collect() == []
