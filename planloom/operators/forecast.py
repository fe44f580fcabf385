"""Seeded completion forecasts, anomaly flags and the effort model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planloom.operators.ranks import exact_quantiles
from planloom.session import cut, drop_cut


def uniform(key: Column) -> Column:
    """A uniform number in (0, 1) from the md5 of a text; the same in every engine and partitioning."""
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def eta_normal(remaining: DataFrame, velocity: DataFrame, trials: int = 2000, seed: int = 42) -> DataFrame:
    """(trial, weeks): remaining effort over a normal draw of the positive velocities, rounded up; without any, 0."""
    pos = F.when(F.col("velocity") > 0, F.col("velocity"))
    s = velocity.agg(F.avg(pos).alias("mu"), F.stddev_pop(pos).alias("sd")).withColumn("sd", F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.col("mu") * 0.25))
    t = remaining.sparkSession.range(trials).withColumnRenamed("id", "trial")
    k = F.concat(F.lit(f"{seed}-"), F.col("trial").cast("string"))
    z = F.sqrt(-2 * F.log(uniform(F.concat(k, F.lit("a"))))) * F.cos(2 * np.pi * uniform(F.concat(k, F.lit("b"))))
    j = t.join(F.broadcast(remaining.join(F.broadcast(s))))
    draw = F.greatest(F.col("mu") + F.col("sd") * z, F.lit(1e-6))
    return j.select("trial", F.when(F.col("mu").isNull(), 0.0).otherwise(F.ceil(F.round(F.col("remaining_effort") / draw, 6)).cast("double")).alias("weeks"))


def eta_bootstrap(remaining: DataFrame, velocity: DataFrame, trials: int = 5000, max_weeks: int = 104, seed: int = 42) -> DataFrame:
    """(trial, weeks): past velocities (at least 0.1) drawn week by week until nothing remains, max_weeks at most.

    The fold over weeks stays in one row and stops adding once done; no trial x week rows arise."""
    past = velocity.agg(F.array_sort(F.collect_list(F.struct("week", "velocity"))).alias("v"))
    past = past.select(F.when((F.size("v") > 0) & (F.aggregate("v", F.lit(0.0), lambda a, x: a + x["velocity"]) != 0), F.transform("v", lambda x: x["velocity"])).otherwise(F.array(F.lit(1.0))).alias("v"))
    t = remaining.sparkSession.range(trials).withColumnRenamed("id", "trial").join(F.broadcast(remaining.join(F.broadcast(past))))
    start = F.struct(F.col("remaining_effort").cast("double").alias("rem"), F.lit(0).alias("w"))

    def step(acc: Column, week: Column) -> Column:
        u = uniform(F.concat_ws("-", F.lit(str(seed)), F.col("trial").cast("string"), week.cast("string")))
        x = F.greatest(F.element_at("v", (F.floor(u * F.size("v")) + 1).cast("int")), F.lit(0.1))
        return F.when(acc["rem"] > 0, F.struct((acc["rem"] - x).alias("rem"), (acc["w"] + 1).alias("w"))).otherwise(acc)

    return t.select("trial", F.aggregate(F.sequence(F.lit(1), F.lit(max_weeks)), start, step)["w"].alias("weeks"))


def summarize(weeks: DataFrame) -> DataFrame:
    q = F.percentile(F.col("weeks").cast("double"), F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return weeks.agg(q.alias("q")).select(F.col("q")[0].alias("p10"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p90"))


def moving_average(velocity: DataFrame, horizon: int = 16, last: int = 5) -> DataFrame:
    """(step, mean): the mean of the last velocities (of fewer than three: of all), for each step ahead."""
    v = velocity.where(F.col("velocity") >= 0)
    r = v.withColumn("r", F.row_number().over(W.orderBy(F.desc("week"))))
    n = v.agg(F.count(F.lit(1)).alias("n"))
    mu = r.join(F.broadcast(n)).agg(F.coalesce(F.avg(F.when((F.col("n") < 3) | (F.col("r") <= last), F.col("velocity"))), F.lit(0.0)).alias("mean"))
    return velocity.sparkSession.range(1, horizon + 1).select(F.col("id").alias("step")).join(F.broadcast(mu))


def holt(values: list[float], horizon: int = 16) -> list[float]:
    """Additive-trend smoothing of one short series; level and trend weights by least squared one-step error on a grid."""
    x = np.asarray([v for v in values if np.isfinite(v) and v >= 0], dtype=float)
    if len(x) < 3:
        return [float(x.mean()) if len(x) else 0.0] * horizon
    best = (np.inf, 0.0, 0.0)
    for a in range(5, 100, 5):
        for b in range(0, 100, 5):
            level, trend, err = x[0], x[1] - x[0], 0.0
            for v in x[1:]:
                e = v - (level + trend)
                err += e * e
                level, trend = level + trend + a / 100 * e, trend + a / 100 * (b / 100) * e
            if err < best[0]:
                best = (err, level, trend)
    return [max(0.0, float(best[1] + best[2] * h)) for h in range(1, horizon + 1)]


def velocity_forecast(velocity: DataFrame, horizon: int = 16) -> DataFrame:
    """(step, mean, eta_p50) for each step ahead: the series with its trend carried on (never below 0), and
    the weeks one unit of effort takes at the median of the last 8 velocities. Fewer than three
    velocities: their mean, eta_p50 0. The series is one row: it is as long as there are weeks."""
    one = velocity.agg(F.array_sort(F.collect_list(F.struct("week", "velocity"))).alias("s")).select(F.transform("s", lambda x: x["velocity"].cast("double")).alias("v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for v in b["v"]:
                good = [float(x) for x in v if x is not None and np.isfinite(x) and x >= 0]
                eta = 1.0 / (float(np.median(good[-8:])) + 1e-9) if len(good) >= 3 else 0.0
                yield pd.DataFrame({"step": np.arange(1, horizon + 1), "mean": holt(good, horizon), "eta_p50": eta})

    return one.mapInPandas(run, "step long, mean double, eta_p50 double")


def _tree(x: np.ndarray, rng: np.random.Generator, depth: int, limit: int):  # noqa: ANN202
    if depth >= limit or len(x) <= 1 or x.max() == x.min():
        return len(x)
    at = rng.uniform(x.min(), x.max())
    return at, _tree(x[x < at], rng, depth + 1, limit), _tree(x[x >= at], rng, depth + 1, limit)


def _expected(n: float) -> float:
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _depths(tree, x: np.ndarray, depth: int = 0) -> np.ndarray:  # noqa: ANN001
    if not isinstance(tree, tuple):
        return np.full(len(x), depth + _expected(tree))
    at, low, high = tree
    out = np.empty(len(x))
    left = x < at
    out[left], out[~left] = _depths(low, x[left], depth + 1), _depths(high, x[~left], depth + 1)
    return out


def anomalies(df: DataFrame, value: str, order: list[str], share: float = 0.1, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """df with score and anomaly: an isolation forest of `trees` trees on `sample` rows each (the rows with
    the smallest hash of `order`, trees * sample at most are gathered); every row is scored, and the
    rows over the exact (1 - share) percentile of scores are anomalies. Missing values count 0."""
    x = F.coalesce(F.when(~F.isnan(value), F.col(value)), F.lit(0.0)).cast("double")
    drawn = np.array([r[0] for r in df.select(x.alias("x"), F.xxhash64(*order).alias("h")).orderBy("h", "x").limit(trees * sample).select("x").collect()])
    rng = np.random.default_rng(seed)
    n = min(sample, len(drawn))
    forest = [_tree(rng.choice(drawn, n, replace=False), rng, 0, int(np.ceil(np.log2(max(n, 2))))) for _ in range(trees)] if n else []

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        a = v.to_numpy(dtype=float)
        mean = np.mean([_depths(t, a) for t in forest], axis=0) if forest else np.zeros(len(a))
        return pd.Series(2.0 ** (-mean / max(_expected(n), 1e-9)))

    scored = cut(df.withColumn("score", score(x)), "scored")
    edge = exact_quantiles(scored, "score", [1 - share])[0]
    return scored.withColumn("anomaly", (F.col("score") > F.lit(edge)).cast("int"))


def _cut_at(t: Column, k: int):  # noqa: ANN202
    return lambda i: F.substring(t, i, F.lit(k))


def effort_model(df: DataFrame, text: str, actual: str, features: int = 1 << 10, trees: int = 10, least: int = 20, seed: int = 42) -> DataFrame:
    """df with effort_p10, effort_p50 and effort_p90: gradient-boosted median of hashed character n-grams,
    the interval from the residuals of held-out rows (a fifth, by hash). With fewer than `least` rows
    of positive effort, zeros."""
    from pyspark.ml.feature import IDF, HashingTF
    from pyspark.ml.regression import GBTRegressor

    t = F.concat(F.lit(" "), F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(" "))
    grams = F.flatten(F.array(*[F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (k - 1), F.lit(1))), _cut_at(t, k)) for k in (3, 4, 5)]))
    rows = df.withColumn("__grams", grams)
    train = rows.where(F.col(actual) > 0)
    if train.count() < least:
        return df.withColumns({c: F.lit(0.0) for c in ("effort_p10", "effort_p50", "effort_p90")})
    held = F.pmod(F.xxhash64(text, actual), F.lit(5)) == 0
    tf = HashingTF(numFeatures=features, inputCol="__grams", outputCol="__tf")
    idf = IDF(inputCol="__tf", outputCol="__x", minDocFreq=2).fit(tf.transform(train.where(~held)))
    model = GBTRegressor(featuresCol="__x", labelCol=actual, predictionCol="effort_p50", lossType="absolute", maxIter=trees, maxDepth=3, seed=seed).fit(idf.transform(tf.transform(train.where(~held))))
    apart = cut(model.transform(idf.transform(tf.transform(train.where(held)))).select((F.col(actual) - F.col("effort_p50")).alias("r")), "residuals")
    q = [x or 0.0 for x in exact_quantiles(apart, "r", [0.1, 0.9])]
    drop_cut(apart)
    out = model.transform(idf.transform(tf.transform(rows)))
    low = F.greatest(F.col("effort_p50") + q[0], F.lit(0.0))
    return out.withColumns({"effort_p10": F.least(low, "effort_p50"), "effort_p90": F.greatest(F.col("effort_p50") + q[1], "effort_p50")}).select(*df.columns, "effort_p10", "effort_p50", "effort_p90")


def attach_effort(df: DataFrame, text: str, actual: str) -> DataFrame:
    """effort_model's columns and effort_score: the actual effort where it is positive, else the model's median."""
    return effort_model(df, text, actual).withColumn("effort_score", F.when(F.col(actual) > 0, F.col(actual)).otherwise(F.col("effort_p50")))


def histogram(weeks: DataFrame) -> DataFrame:
    """(bin, low, high, n): min(30, max(6, floor(sqrt(n)))) equal bins of the draws."""
    s = weeks.agg(F.min("weeks").alias("lo"), F.max("weeks").alias("hi"), F.least(F.lit(30), F.greatest(F.lit(6), F.floor(F.sqrt(F.count(F.lit(1)))))).cast("int").alias("bins"))
    j = weeks.join(F.broadcast(s))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / F.col("bins")).otherwise(1.0)
    b = F.least(F.floor((F.col("weeks") - F.col("lo")) / width), F.col("bins") - 1).cast("int")
    return j.groupBy(b.alias("bin"), (F.col("lo") + b * width).alias("low"), (F.col("lo") + (b + 1) * width).alias("high")).agg(F.count(F.lit(1)).alias("n"))
