import numpy as np
from pyspark.sql import functions as F

from planloom.operators import forecast, inequality
from planloom.operators.ranks import exact_quantiles, running_sums


def test_quantiles(spark):
    rng = np.random.default_rng(1)
    for values in (rng.normal(size=500), np.round(rng.exponential(size=400), 1), np.array([3.0]), np.array([1e308, -1e308, 0.0]), np.array([5.0] * 9 + [1e-300])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),), (float("inf"),)], "x double")
        for bins in (2, 1024):
            got = exact_quantiles(df, "x", [0.0, 0.1, 0.5, 0.95, 1.0], bins=bins)
            assert np.allclose(got, np.quantile(values, [0.0, 0.1, 0.5, 0.95, 1.0]), rtol=1e-12)
    weighted = spark.createDataFrame([(1.0, 3), (2.0, 1), (9.0, 2)], "x double, k int")
    assert exact_quantiles(weighted, "x", [0.5], "k") == [1.5]
    assert exact_quantiles(weighted.limit(0), "x", [0.5, 0.9]) == [None, None]


def test_running_sums(spark):
    df = spark.createDataFrame([(i % 7, i, float(i)) for i in range(200)], "a int, b int, x double").repartition(5)
    got = [(r.a, r.b, r.t, r.n) for r in running_sums(df, ["a", "b"], t="x", n=F.lit(1)).orderBy("a", "b").collect()]
    t, want = 0.0, []
    for k, (a, b, x) in enumerate(sorted((i % 7, i, float(i)) for i in range(200))):
        t += x
        want.append((a, b, t, k + 1))
    assert got == want


def test_huber_and_winsorize(spark):
    x = np.concatenate([np.random.default_rng(2).normal(10, 2, 300), [500.0, 900.0]])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    mu = np.median(x)
    for _ in range(50):
        r = np.abs(x - mu)
        w = np.minimum(1.0, 1.345 * (np.median(r) + 1e-6) / (r + 1e-6))
        new = (w * x).sum() / w.sum()
        if abs(new - mu) < 1e-6:
            break
        mu = new
    assert abs(inequality.huber_mean(df, "x").first()[0] - mu) < 1e-9
    low, high = np.quantile(x, [0.05, 0.95])
    assert np.allclose(sorted(r.x_w for r in inequality.winsorize(df, "x").collect() if r.x_w is not None), np.sort(np.clip(x, low, high)))
    assert [r.x_w for r in inequality.winsorize(df.where("x is null"), "x").collect()] == [None]


def test_velocity_forecast(spark):
    df = spark.createDataFrame([(w, 10.0 + 2 * w) for w in range(1, 9)], "week int, velocity double")
    rows = forecast.velocity_forecast(df, 4).orderBy("step").collect()
    assert [round(r.mean, 6) for r in rows] == [28.0, 30.0, 32.0, 34.0] and abs(rows[0].eta_p50 - 1 / 19) < 1e-6
    assert [(r.mean, r.eta_p50) for r in forecast.velocity_forecast(df.limit(2), 2).collect()] == [(13.0, 0.0)] * 2


def test_attach_effort(spark):
    rows = [(i, "build the api" if i % 2 else "write notes", 8.0 if i % 2 else 2.0) for i in range(60)] + [(99, "build the api", None), (100, None, float("nan"))]
    got = {r.i: r for r in forecast.attach_effort(spark.createDataFrame(rows, "i int, t string, actual double").where("actual is null or not isnan(actual)"), "t", "actual").collect()}
    assert got[0].effort_score == 2.0 and 5 < got[99].effort_score <= 8.5 and all(r.effort_p10 <= r.effort_p50 <= r.effort_p90 for r in got.values())
