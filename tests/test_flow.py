import pytest

from planloom.operators import flow, inequality


def tasks(spark, rows):
    return spark.createDataFrame(rows, "week int, effort double, status string, planned double, cost double")


@pytest.fixture(scope="module")
def three(spark):
    return tasks(spark, [(1, 2.0, "Completed", 1.0, 1.0), (1, None, "In Progress", 1.0, 1.0), (3, 4.0, "completed", 1.0, 1.0), (None, 9.0, "Completed", 1.0, 1.0)])


def test_burn(three):
    assert [tuple(r) for r in flow.burnup(three).orderBy("week").collect()] == [(1, 3.0, 2.0), (3, 7.0, 6.0)]
    assert [tuple(r) for r in flow.burndown(three).orderBy("week").collect()] == [(1, 1.0), (3, 1.0)]
    assert [tuple(r) for r in flow.velocity(three).orderBy("week").collect()] == [(1, 2.0), (3, 4.0)]
    assert flow.remaining_effort(three).first()[0] == 0.0


def test_earned_schedule(spark):
    s = lambda rows: spark.createDataFrame(rows, "week int, scope_cumulative double, completed_cumulative double")
    assert tuple(flow.earned_schedule(s([(1, 10.0, 5.0), (2, 20.0, 10.0), (3, 30.0, 15.0)])).first()) == (1.5, 3.0, -1.5, 0.5)
    assert flow.earned_schedule(s([(1, 10.0, 2.0), (2, 20.0, 5.0)])).first().es == 0.5
    assert flow.earned_schedule(s([(1, 10.0, 2.0)])).collect() == []


def test_what_if(spark):
    rem = spark.createDataFrame([(10.0,)], "remaining_effort double")
    vel = spark.createDataFrame([(1, 0.0), (2, 2.0), (3, 4.0)], "week int, velocity double")
    assert {r.name: r.eta_weeks for r in flow.what_if(rem, vel).collect()} == {"baseline": 4.0, "velocity+10%": 4.0, "velocity+25%": 3.0, "scope-20%": 3.0}
    assert flow.what_if(rem, vel.where("velocity = 0")).collect() == []


def test_cusum_is_the_recursion(spark):
    x = [3.0, 0.0, 8.0, 2.0, 9.0, 9.0, 1.0]
    got = flow.cusum(spark.createDataFrame(list(enumerate(x)), "week int, velocity double")).orderBy("week").collect()
    mu = sum(x) / len(x)
    sd = (sum((v - mu) ** 2 for v in x) / len(x)) ** 0.5
    p = n = 0.0
    for v, r in zip(x, got):
        p, n = max(0.0, p + v - mu - sd / 2), min(0.0, n + v - mu + sd / 2)
        assert r.cusum_pos == pytest.approx(p, abs=1e-9) and r.cusum_neg == pytest.approx(n, abs=1e-9)


def test_evm_fallbacks(spark):
    r = flow.earned_value(tasks(spark, [(1, 2.0, "Completed", 0.0, 0.0), (2, 4.0, "Not Started", 0.0, 0.0)])).orderBy("week").collect()
    assert [x.pv_sum for x in r] == [3.0, 6.0] and [x.ac_sum for x in r] == [2.0, 2.0]


@pytest.mark.parametrize(("values", "want"), [([1.0] * 4, 0.0), ([0.0, 0.0, 0.0, 4.0], 0.75), ([], 0.0), ([0.0], 0.0), ([-5.0, 1.0], 0.5)])
def test_gini(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert inequality.gini(df, "x").first()[0] == pytest.approx(want)


def test_measures(spark):
    r = inequality.measures(spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double"), "x").first()
    assert r.theil_t == pytest.approx(0.1308, abs=1e-4) and r.hoover == pytest.approx(0.25)
    w = inequality.winsorize(spark.createDataFrame([(float(i),) for i in range(1, 101)], "x double"), "x").selectExpr("min(x_w)", "max(x_w)").first()
    assert (w[0], w[1]) == (pytest.approx(5.95), pytest.approx(95.05))
