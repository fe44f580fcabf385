import math

from planloom.operators import impute

SCHEMA = "row_id long, task string, project string, status string, week int, planned double, cost double"


def fills(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r.row_id, r.field_name): r for r in impute.hot_deck(df, "row_id", ["planned", "cost"], "task", "project", "status", "week", **kw).collect()}


def test_levels(spark):
    rows = [
        (1, "t1", "p", "a", 1, 10.0, 100.0), (2, "t1", "p", "a", 1, None, 100.0),  # the same record
        (3, "t3", "p", "a", 2, 11.0, None), (4, "t4", "p", "a", 2, 10.5, 110.0), (5, "t5", "p", "b", 9, 90.0, 900.0),
        (6, "t6", "q", None, None, float("nan"), -1.0), (7, "t7", "q", None, 3, 5.0, 0.0),
    ]
    got = fills(spark, rows)
    assert set(got) == {(2, "planned"), (3, "cost"), (6, "planned"), (6, "cost")}
    assert (got[2, "planned"].filled_value, got[2, "planned"].level, got[2, "planned"].donors[0]) == (10.0, "record", 1)
    assert got[3, "cost"].level == "group and category" and got[3, "cost"].filled_value in (100.0, 110.0)
    assert got[6, "cost"].filled_value == 0.0 and got[6, "cost"].level == "group and time" and got[2, "planned"].filled_label is None


def test_stand_ins(spark):
    real = [(i, f"t{i}", "p", "a", 1, 5.0 + i % 7, 50.0 + i) for i in range(1500)]
    odd = [(9000 + i, f"u{i}", "p", "a", 1, 9999.0, 88888888.0) for i in range(20)] + [(9900, "v", "p", "a", 1, 700.0, 44444.0)]
    df = spark.createDataFrame(real + odd, SCHEMA)
    assert impute.stand_ins(df, ["planned", "cost"]) == {"planned": [9999.0], "cost": [88888888.0]}


def test_stand_ins_at_every_size(spark):
    """30 uses of a stand-in are found in 40 000 rows and in 400 000."""
    odd = spark.createDataFrame([(9999.0, 88888888.0)] * 30 + [(12345678.0, 800.0)] * 30 + [(444.4, 22222.0)], "planned double, cost double")
    for n in (900, 40_000, 400_000):
        real = spark.range(n).selectExpr("CAST(5 + id % 7 AS DOUBLE) AS planned", "CAST(500 + id % 600 AS DOUBLE) AS cost")
        assert impute.stand_ins(real.unionByName(odd), ["planned", "cost"]) == {"planned": [9999.0, 12345678.0], "cost": [88888888.0]}


def test_no_donor_and_empty(spark):
    got = fills(spark, [(1, "t", "p", "a", 1, None, 3.0)])
    assert got[1, "planned"].level == "none" and got[1, "planned"].filled_value is None
    assert fills(spark, []) == {}


def test_stand_ins_do_not_hang_on_the_number_of_rows(spark):
    odd = [(9000 + i, f"u{i}", "p", "a", 1, 9999.0, 60.0) for i in range(2)]
    for n in (997, 999, 1001):
        df = spark.createDataFrame([(i, f"t{i}", "p", "a", 1, 5.0 + i % 7, 50.0 + i) for i in range(n)] + odd, SCHEMA)
        assert impute.stand_ins(df, ["planned", "cost"]) == {"planned": [9999.0], "cost": []}


def test_fills_do_not_hang_on_cell_rows(spark):
    """A hot block with many equal values, whole and cut into small cells."""
    rows = [(i, f"t{i % 700}", f"p{i % 2}", "ab"[i % 3 == 0], i % 9, None if i % 7 == 0 else float(i % 40), None if i % 5 == 0 else float(3 * (i % 40) + i % 3)) for i in range(1, 3000)]
    whole = fills(spark, rows)
    for cell_rows in (20, 333):
        cut = fills(spark, rows, cell_rows=cell_rows)
        assert {k: (r.filled_value, r.donors, r.level) for k, r in cut.items()} == {k: (r.filled_value, r.donors, r.level) for k, r in whole.items()}


def test_mixed_distance_and_majority(spark):
    """Of equally placed donors the one alike in category and time wins; categorical gaps take the weighted majority."""
    rows = [(i, f"t{i}", "p", "a" if i % 2 else "b", i % 2, 8.0 + i * 1e-6, 100.0 if i % 2 else 900.0) for i in range(40)] + [(90, "x", "p", "a", 1, 8.0, None)]
    assert fills(spark, rows)[90, "cost"].filled_value == 100.0
    rows += [(91, "y", "p", None, 1, 8.0, 100.0), (92, "z", "p", " ", 0, 8.0, 900.0), (93, "t3", "p", None, 1, 8.0, 100.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.row_id: r for r in impute.hot_deck(df, "row_id", ["planned", "cost"], "task", "project", "status", "week", labels=["status"], fill=["status"]).collect()}
    assert {i: (r.field_name, r.filled_label, r.filled_value) for i, r in got.items()} == {91: ("status", "a", None), 92: ("status", "b", None), 93: ("status", "a", None)}
    assert got[93].level == "record" and len(got[91].donors) == got[91].n_donors


def test_hot_block_is_spread(spark):
    rows = [(i, f"t{i}", "p", "a", 1, 8.0, float(i)) for i in range(300)] + [(1000 + i, f"g{i}", "p", "a", 1, 8.0, None) for i in range(30)]
    got = fills(spark, rows, cell_rows=50)
    assert len(got) == 30 and all(r.n_donors >= 1 and r.filled_value is not None for r in got.values())


def test_fill_is_close(spark):
    """Hidden amounts come back within a third in the median: cost follows planned in the fixture."""
    rows = [(i, f"t{i}", f"p{i % 3}", "a", i % 5, 1.0 + (i * 37 % 400) / 10, None if i % 11 == 0 else 20 * (1.0 + (i * 37 % 400) / 10)) for i in range(1, 1200)]
    got = fills(spark, rows)
    errors = sorted(abs(math.log(got[i, "cost"].filled_value / (20 * p))) for i, _, _, _, _, p, c in rows if c is None)
    assert errors[len(errors) // 2] < math.log(4 / 3)


def test_table(spark):
    df = spark.createDataFrame([(1, "t", "p", "a", 1, None, 3.0), (2, "t", "p", "a", 1, 4.0, 3.0)], SCHEMA)
    t = impute.filled_table(df, impute.hot_deck(df, "row_id", ["planned", "cost"], "task", "project", "status", "week"), "row_id", ["planned", "cost"])
    assert sorted((r.row_id, r.planned, r.planned_filled, r.cost_filled) for r in t.collect()) == [(1, 4.0, True, False), (2, 4.0, False, False)]
