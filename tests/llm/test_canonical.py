import pytest

from planloom.llm.canonical import STATUS_ALIASES, STATUS_NOISE, Matcher, match_canonical
from planloom.llm.edits import edits

NAMES = list(enumerate(STATUS_ALIASES, 1))
ID = {n: i for i, n in NAMES}
CASES = [
    ("Completed ", "Completed"), ("IN_PROGRESS", "In Progress"), ("InReview.", "In Review"), ("done!!", "Completed"), ("fertig (12/03)", "Completed"), ("đang làm @ 3/4", "In Progress"),
    ("0% ?", "Not Started"), ("100%", "Completed"), ("haflway htrough", "In Progress"), ("wrappe pu", "Completed"), ("status: cxl", "Cancelled"), ("✅ Blokced", "Blocked"), ("waiting for sign-off", "Awaiting Approval"),
    ("now pushed to next quarter", "Deferred"), ("went live since Monday", "Deployed"), ("re-opned", "Reopened"), ("rdy for tset", "Ready for Testing"), ("cnopl.", "Completed"), ("en psaa", "On Hold"), ("en pausa pls check", "On Hold"),
    ("see ticket (blocked)", "Blocked"), ("(done)", "Completed"),
]


@pytest.mark.parametrize(("value", "name"), CASES)
def test_means(value, name):
    assert Matcher(NAMES, STATUS_ALIASES, 0.57, STATUS_NOISE).match(value)[0] == ID[name]


@pytest.mark.parametrize("value", ["check mail", "42", "???", "red", "P2", "see notes!", "low priority", "x" * 5000, "--", "13/04"])
def test_means_none(value):
    assert Matcher(NAMES, STATUS_ALIASES, 0.57, STATUS_NOISE).match(value)[:2] == (-1, "none")


def test_edits():
    assert [edits("abc", x, 3) for x in ("abc", "acb", "ab", "xyz", "")] == [0, 1, 1, 3, 3] and edits("abcdef", "uvwxyz", 2) == 3


def test_rows(spark):
    df = spark.createDataFrame([(1, "Completed", 9), (2, None, 9), (3, " ", 9), (4, "doen", 9), (4, "doen", 9)], "row_id long, s string, score int")
    names = spark.createDataFrame([(3, "Completed"), (None, None)], "i int, n string")
    got = sorted((r.row_id, r.canonical_id, r.how) for r in match_canonical(df, "s", names, "i", "n", ["row_id"], STATUS_ALIASES).collect())
    assert got == [(1, 3, "exact"), (2, None, "empty"), (3, None, "empty"), (4, 3, "similar"), (4, 3, "similar")]
    assert {r.how for r in match_canonical(df, "s", names.limit(0), "i", "n", ["row_id"], STATUS_ALIASES).collect()} == {"empty", "none"}
    with pytest.raises(ValueError, match="more than 0"):
        match_canonical(df, "s", names, "i", "n", ["row_id"], STATUS_ALIASES, max_names=0)


def test_other_lists(spark):
    """Nothing but the given names, aliases and noise counts."""
    df = spark.createDataFrame([(1, "NYC!"), (2, "the big apple"), (3, "Nwe York"), (4, "done"), (5, "Bostn, USA")], "row_id long, s string")
    names = spark.createDataFrame([(1, "New York"), (2, "Boston")], "i int, n string")
    import re

    got = {r.row_id: r.canonical_id for r in match_canonical(df, "s", names, "i", "n", ["row_id"], {"New York": ("nyc", "big apple")}, re.compile(r",\s*USA$")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: -1, 5: 2}
