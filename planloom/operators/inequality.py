"""Measures of inequality over one numeric column. Ranks come from running sums over ranges, quantiles from counting: no task sorts a whole column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planloom.operators.ranks import exact_quantiles, running_sums
from planloom.session import cut, drop_cut


def _clean(df: DataFrame, value: str) -> DataFrame:
    v = df.select(F.col(value).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    return v.select(F.greatest("x", F.lit(0.0)).alias("x"))


def summed_ranks(df: DataFrame) -> DataFrame:
    """(x, k, s): distinct values x with how often they occur and the sum of their ranks."""
    by = df.groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("k"))
    before = F.col("upto") - F.col("k")
    return running_sums(by, ["x"], upto="k").select("x", "k", (F.col("k") * before + F.col("k") * (F.col("k") + 1) / 2).alias("s"))


def gini(df: DataFrame, value: str) -> DataFrame:
    """One row (gini); 0 when there is nothing to share. Negative values count as 0."""
    a = summed_ranks(_clean(df, value)).agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("x")).alias("t"), F.sum(F.col("x") * F.col("s")).alias("w"))
    return a.select(F.when(F.coalesce("t", F.lit(0.0)) > 1e-8, 2 * F.col("w") / (F.col("n") * F.col("t")) - (F.col("n") + 1) / F.col("n")).otherwise(0.0).alias("gini"))


def measures(df: DataFrame, value: str, eps: float = 0.5) -> DataFrame:
    """One row (theil_t, theil_l, atkinson, hoover). The Theil means run over positive values only."""
    x = _clean(df, value)
    mu = x.agg(F.avg("x").alias("mu"))
    j = x.join(F.broadcast(mu)).where("mu > 0")
    pos = F.when(F.col("x") > 0, F.col("x") / F.col("mu"))
    floor = F.greatest("x", F.lit(1e-12))
    a = j.agg(F.avg(pos * F.log(pos)).alias("t"), F.avg(-F.log(pos)).alias("l"), F.avg(F.pow(floor, F.lit(1 - eps))).alias("p"), F.avg(floor).alias("m"), F.avg(F.log(floor)).alias("g"), F.avg(F.abs(F.col("x") - F.col("mu")) / F.col("mu")).alias("h"))
    centre = F.exp("g") if eps == 1 else F.pow("p", F.lit(1 / (1 - eps)))
    z = F.lit(0.0)
    return a.select(F.coalesce("t", z).alias("theil_t"), F.coalesce("l", z).alias("theil_l"), F.coalesce(1 - centre / F.col("m"), z).alias("atkinson"), F.coalesce(0.5 * F.col("h"), z).alias("hoover"))


def theil_decomposition(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row (t_total, t_between, t_within): between is the Theil of group sums, within is weighted by share."""
    d = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("x")).where(F.col("g").isNotNull() & F.col("x").isNotNull()).withColumn("x", F.greatest("x", F.lit(0.0)))
    by = d.groupBy("g").agg(F.avg("x").alias("mu_g"), F.sum("x").alias("s"))
    mu = by.agg(F.avg("s").alias("mu_s"), F.sum("s").alias("total"))
    every = d.agg(F.avg("x").alias("mu"))
    term = lambda x, m: F.when((x > 0) & (m > 0), x / m * F.log(x / m))
    total = d.join(F.broadcast(every)).agg(F.avg(term(F.col("x"), F.col("mu"))).alias("t_total"))
    between = by.join(F.broadcast(mu)).agg(F.avg(term(F.col("s"), F.col("mu_s"))).alias("t_between"))
    each = d.join(by, "g").groupBy("g").agg(F.avg(term(F.col("x"), F.col("mu_g"))).alias("t"), F.first("s").alias("s"))
    within = each.join(F.broadcast(mu)).agg(F.sum(F.col("s") / F.col("total") * F.coalesce("t", F.lit(0.0))).alias("t_within"))
    return total.join(F.broadcast(between)).join(F.broadcast(within)).na.fill(0.0)


def lorenz(df: DataFrame, key: str, value: str) -> DataFrame:
    """(rank, population_share, value_share) over the keys' values in ascending order; keys are already aggregated."""
    d = df.select(F.col(key).alias("k"), F.col(value).cast("double").alias("x")).where(F.col("x").isNotNull()).withColumn("x", F.greatest("x", F.lit(0.0)))
    run = running_sums(d, ["x", "k"], rank=F.lit(1), upto="x")
    whole = run.agg(F.max("rank").alias("n"), F.max("upto").alias("t"))
    j = run.join(F.broadcast(whole))
    return j.select(F.col("rank").cast("long").alias("rank"), (F.col("rank") / F.col("n")).alias("population_share"), F.when(F.col("t") > 0, F.col("upto") / F.col("t")).otherwise(0.0).alias("value_share"))


def winsorize(df: DataFrame, value: str, lower: float = 0.05, upper: float = 0.95) -> DataFrame:
    """df with <value>_w: clipped to the interpolated quantiles of the finite values."""
    low, high = exact_quantiles(df, value, [lower, upper])
    v = F.col(value).cast("double")
    return df.withColumn(f"{value}_w", F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(low)), F.lit(high))) if low is not None else v)


def huber_mean(df: DataFrame, value: str, c: float = 1.345, eps: float = 1e-6, max_iter: int = 50) -> DataFrame:
    """One row (huber_mean) by iterated weights from the median; each round is a few aggregates over the distinct values."""
    x = cut(df.select(F.col(value).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf"))).groupBy("x").agg(F.count(F.lit(1)).alias("k")), "values")
    spark = df.sparkSession
    mu = exact_quantiles(x, "x", [0.5], "k")[0]
    if mu is None:
        return spark.createDataFrame([(0.0,)], "huber_mean double")
    for _ in range(max_iter):
        r = F.abs(F.col("x") - mu)
        s = exact_quantiles(x, r, [0.5], "k")[0] + eps
        w = F.least(F.lit(1.0), c * s / (r + eps)) * F.col("k")
        new = x.agg(F.sum(w * F.col("x")) / F.sum(w)).first()[0]
        if abs(new - mu) < eps:
            break
        mu = new
    drop_cut(x)
    return spark.createDataFrame([(float(mu),)], "huber_mean double")
