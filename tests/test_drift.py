import datetime as dt
import json

from planloom.operators import drift

FIELDS = [("card_no", "number"), ("task", "string"), ("planned_effort", "number"), ("actual_cost", "number"), ("skills", "array")]


def tables(spark, files):
    """files: [(file_id, tracker, [line dicts or texts])] in order of export."""
    day = dt.datetime(2024, 1, 1)
    f = spark.createDataFrame([(i, t, day + dt.timedelta(days=k)) for k, (i, t, _) in enumerate(files)], "file_id long, tracker_id long, exported_at timestamp")
    rows = [(i, n, x if isinstance(x, (str, type(None))) else json.dumps(x)) for i, _, ls in files for n, x in enumerate(ls)]
    lines = spark.createDataFrame(rows, "file_id long, line_no int, payload string")
    return lines, f, spark.createDataFrame([(a, b, "") for a, b in FIELDS], "field_name string, value_kind string, meaning string")


def found(spark, files):
    lines, f, fields = tables(spark, files)
    return sorted(tuple(r) for r in drift.changes(drift.presence(drift.resolved_footers(lines, f, fields)), f).collect())


def test_changes(spark):
    files = [
        (10, 1, [{"Card_No": 1, "Task": "a", "Estimate": 2.5}, "{broken", "", None]),
        (7, 1, [{"Card_No": 1, "Task": ["a"], "Estimate": 2.5}, {"Card_No": 2, "Task": ["b"], "Estimate": "stray"}, {"Card_No": 3, "Task": None, "Estimate": 4}]),
        (8, 1, [{"Card_No": 1, "task": "a", "Ist-Kosten": None}]),
        (9, 1, ["not json", "[1]"]),
        (11, 2, [{"card no": 1}]),
    ]
    assert found(spark, files) == [
        (7, "task", "retyped"), (8, "actual_cost", "added"), (8, "planned_effort", "removed"), (8, "task", "renamed"), (8, "task", "retyped"),
        (9, "actual_cost", "removed"), (9, "card_no", "removed"), (9, "task", "removed"),
    ]


def test_unknown_name_by_evidence(spark):
    files = [(1, 1, [{"card_no": i, "planned_effort": 10.5 + i} for i in range(5)]), (2, 1, [{"card_no": i, "qqq": [10.5 + i]} for i in range(5)])]
    assert found(spark, files) == [(2, "planned_effort", "renamed"), (2, "planned_effort", "retyped")]


def test_redelivery_and_empty(spark):
    files = [(1, 1, [{"card_no": 1}]), (2, 1, [{"card_no": 1}])]
    assert found(spark, files) == []
    lines, f, fields = tables(spark, files)
    assert drift.changes(drift.presence(drift.resolved_footers(lines.limit(0), f, fields)), f).collect() == []


def test_one_table(spark):
    files = [(1, 1, [{"CARD_NO": 1, "AC": "EUR 1 074.15", "Task": {"title": "x", "lang": "en"}, "skills": ["a", "b"]}, {"CARD_NO": 2, "AC": "138,32"}, {"CARD_NO": 3, "AC": {"amount": 5.5, "unit": "EUR"}}])]
    lines, f, fields = tables(spark, files)
    got = {r.card_no: (r.task, r.actual_cost, r.skills) for r in drift.one_table(lines, drift.resolved_footers(lines, f, fields), fields).collect()}
    assert got == {1.0: ("x", 1074.15, '["a","b"]'), 2.0: (None, 138.32, None), 3.0: (None, 5.5, None)}


def test_lifespans(spark):
    files = [(1, 1, [{"Card_No": 1}]), (2, 1, [{"Card_No": 1}]), (3, 1, [{"card_no": 1}])]
    lines, f, fields = tables(spark, files)
    got = sorted((r.name, r.first_file, r.last_file, r.n_files) for r in drift.lifespans(drift.presence(drift.resolved_footers(lines, f, fields))).collect())
    assert got == [("Card_No", 1, 2, 2), ("card_no", 3, 3, 1)]


def test_numbers(spark):
    """JSON numbers come out as they are; in text the last kind of sign is decimal unless it is repeated."""
    values = [
        (1234567890123, 1234567890123.0), (1e10, 1e10), ({"amount": 1e10}, 1e10), ("1234567890123", 1234567890123.0), ("1.234.567", 1234567.0), ("1e10", 1e10), ("1,234.56", 1234.56), ("1.234,56", 1234.56),
        ("1,234,567.5", 1234567.5), ("1 354.24€", 1354.24), ("-4,5", -4.5), ("n/a", None), ("", None), ([2.5], 2.5), (None, None), ("9" * 500, None),
    ]
    lines, f, fields = tables(spark, [(1, 1, [{"card_no": i, "actual_cost": v} for i, (v, _) in enumerate(values)])])
    got = {int(r.card_no): r.actual_cost for r in drift.one_table(lines, drift.resolved_footers(lines, f, fields), fields).collect()}
    want = dict(enumerate(w for _, w in values))
    assert {k: v for k, v in got.items() if k != len(values) - 1} == {k: v for k, v in want.items() if k != len(values) - 1}
