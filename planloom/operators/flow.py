"""Weekly flow series. All windows run over rows already aggregated by week, never over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from planloom.session import cut

def _week() -> WindowSpec:
    return W.orderBy("week")


def _run() -> WindowSpec:
    return _week().rowsBetween(W.unboundedPreceding, W.currentRow)


def is_done(status: Column) -> Column:
    """Contains 'completed' in any case; null is not done."""
    return F.coalesce(F.lower(status).contains("completed"), F.lit(False))


def status_bin(status: Column) -> Column:
    """Completed, In Progress or Not Started by words contained; completed wins."""
    s = F.coalesce(F.lower(status), F.lit(""))
    has = lambda *w: F.lit(False) if not w else [s.contains(x) for x in w]
    done, doing = has("done", "completed", "hoàn", "xong"), has("progress", "doing", "đang", "wip")
    any_of = lambda cs: cs[0] if len(cs) == 1 else cs[0] | any_of(cs[1:])
    return F.when(any_of(done), "Completed").when(any_of(doing), "In Progress").otherwise("Not Started")


def weekly(tasks: DataFrame) -> DataFrame:
    """(week, scope, completed): effort by week; a task without effort counts 1."""
    e = F.coalesce(F.col("effort"), F.lit(1.0))
    return tasks.where(F.col("week").isNotNull()).groupBy("week").agg(F.sum(e).alias("scope"), F.sum(F.when(is_done(F.col("status")), e).otherwise(0.0)).alias("completed"))


def pace(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining_effort, velocity) of one pass over the tasks: both come from a written table of weekly sums."""
    open_effort = F.sum(F.when(~is_done(F.col("status")), F.col("effort"))).alias("open")
    e = F.coalesce(F.col("effort"), F.lit(1.0))
    by = cut(tasks.groupBy("week").agg(F.sum(F.when(is_done(F.col("status")), e).otherwise(0.0)).alias("completed"), open_effort), "weeks")
    line = by.where(F.col("week").isNotNull()).select("week", F.sum("completed").over(_run()).alias("completed_cumulative"))
    return by.agg(F.coalesce(F.sum("open"), F.lit(0.0)).alias("remaining_effort")), _steps(line)


def burnup(tasks: DataFrame) -> DataFrame:
    return weekly(tasks).select("week", F.sum("scope").over(_run()).alias("scope_cumulative"), F.sum("completed").over(_run()).alias("completed_cumulative"))


def burndown(tasks: DataFrame) -> DataFrame:
    return burnup(tasks).select("week", (F.col("scope_cumulative") - F.col("completed_cumulative")).alias("remaining_effort"))


def cumulative_flow(tasks: DataFrame) -> DataFrame:
    """Running effort of the three states whose title-cased name is exact."""
    names = ["Not Started", "In Progress", "Completed"]
    p = tasks.select("week", F.initcap(F.lower("status")).alias("s"), F.coalesce("effort", F.lit(1.0)).alias("e")).where(F.col("week").isNotNull()).groupBy("week").pivot("s", names).agg(F.sum("e"))
    return p.select("week", *[F.sum(F.coalesce(F.col(f"`{n}`"), F.lit(0.0))).over(_run()).alias(n.lower().replace(" ", "_")) for n in names])


def binned_flow(tasks: DataFrame) -> DataFrame:
    names = ["Not Started", "In Progress", "Completed"]
    p = tasks.select("week", status_bin(F.col("status")).alias("s"), "effort").where(F.col("week").isNotNull()).groupBy("week").pivot("s", names).agg(F.sum("effort"))
    return p.select("week", *[F.sum(F.coalesce(F.col(f"`{n}`"), F.lit(0.0))).over(_run()).alias(n.lower().replace(" ", "_")) for n in names])


def burndown_detail(tasks: DataFrame) -> DataFrame:
    """(week, total_effort, completed_effort, remaining_effort >= 0), states by bins, missing effort skipped."""
    e = F.coalesce("effort", F.lit(0.0))
    by = tasks.where(F.col("week").isNotNull()).groupBy(F.greatest("week", F.lit(1)).alias("week")).agg(F.sum(e).alias("total_effort"), F.sum(F.when(status_bin(F.col("status")) == "Completed", e).otherwise(0.0)).alias("completed_effort"))
    return by.withColumn("remaining_effort", F.greatest(F.sum(F.col("total_effort") - F.col("completed_effort")).over(_run()), F.lit(0.0)))


def burnup_filled(tasks: DataFrame) -> DataFrame:
    """Burnup whose completed line exists only in weeks with completed tasks and is carried forward over the others."""
    e = F.coalesce("effort", F.lit(0.0))
    done = F.sum(F.when(status_bin(F.col("status")) == "Completed", e))
    by = tasks.where(F.col("week").isNotNull()).groupBy("week").agg(F.sum(e).alias("s"), done.alias("c"))
    line = by.withColumns({"scope_cumulative": F.sum("s").over(_run()), "line": F.when(F.col("c").isNotNull(), F.sum("c").over(_run()))})
    return line.select("week", "scope_cumulative", F.coalesce(F.last("line", ignorenulls=True).over(_run()), F.lit(0.0)).alias("completed_cumulative"))


def velocity(tasks: DataFrame) -> DataFrame:
    """First differences of the completed line, not below 0; the first week is itself."""
    return _steps(burnup(tasks))


def _steps(line: DataFrame) -> DataFrame:
    before = F.lag("completed_cumulative").over(_week())
    return line.select("week", F.greatest(F.coalesce(F.col("completed_cumulative") - before, F.col("completed_cumulative")), F.lit(0.0)).alias("velocity"))


def remaining_effort(tasks: DataFrame) -> DataFrame:
    return tasks.agg(F.coalesce(F.sum(F.when(~is_done(F.col("status")), F.col("effort"))), F.lit(0.0)).alias("remaining_effort"))


def earned_schedule(series: DataFrame) -> DataFrame:
    """One row (es, at, sv_t, spi_t): the week at which the scope line met today's completed effort, by
    interpolation, outside the line by extrapolation. No row for fewer than two weeks or nothing done."""
    n = series.select("week", F.col("scope_cumulative").alias("pv"), F.col("completed_cumulative").alias("ev"), F.row_number().over(_week()).alias("i"), F.lead("scope_cumulative").over(_week()).alias("pv1"), F.lead("week").over(_week()).alias("week1"))
    now = n.agg(F.max_by("ev", "week").alias("ev"), F.max("week").alias("at"), F.count(F.lit(1)).alias("n"), F.max("ev").alias("most"))
    # both sides are weekly or single rows
    place = n.join(F.broadcast(now.select(F.col("ev").alias("now"))), F.col("pv") <= F.col("now"), "left").agg(F.count("now").alias("k"))
    one = now.join(F.broadcast(place)).where("n >= 2 and most > 0").select("ev", "at", F.greatest(F.least(F.col("k") - 1, F.col("n") - 2), F.lit(0)).alias("idx"))
    seg = n.join(F.broadcast(one.select("idx", F.col("ev").alias("now"), "at")), F.col("i") == F.col("idx") + 1)
    es = F.when(F.col("pv1") - F.col("pv") <= 1e-9, F.col("week").cast("double")).otherwise(F.col("week") + (F.col("now") - F.col("pv")) / (F.col("pv1") - F.col("pv")) * (F.col("week1") - F.col("week")))
    return seg.select(es.alias("es"), F.col("at").cast("double").alias("at")).select("es", "at", (F.col("es") - F.col("at")).alias("sv_t"), F.when(F.col("at") > 0, F.col("es") / F.col("at")).alias("spi_t"))


def earned_value(tasks: DataFrame) -> DataFrame:
    """Weekly earned value: EV, PV and AC run up; without any plan the total is spread evenly, without any cost AC is EV."""
    done = F.col("status") == "Completed"
    w = tasks.where(F.col("week").isNotNull()).groupBy("week").agg(
        F.coalesce(F.sum(F.when(done, F.col("effort"))), F.lit(0.0)).alias("ev_done"), F.coalesce(F.sum(F.col("planned").cast("double")), F.lit(0.0)).alias("pv"),
        F.coalesce(F.sum(F.col("cost").cast("double")), F.lit(0.0)).alias("ac"), F.count_if(done).alias("n_done"), F.coalesce(F.sum("effort"), F.lit(0.0)).alias("effort"),
    )
    whole = W.partitionBy()
    w = w.withColumns({"no_plan": F.max(F.abs("pv")).over(whole) == 0, "no_cost": F.sum("ac").over(whole) == 0, "spread": F.sum("effort").over(whole) / F.count(F.lit(1)).over(whole)})
    w = w.withColumns({"pv": F.when(F.col("no_plan"), F.col("spread")).otherwise(F.col("pv")), "ac": F.when(F.col("no_cost"), F.col("ev_done")).otherwise(F.col("ac"))})
    s = w.select("week", "n_done", F.col("ev_done").alias("velocity"), F.sum("ev_done").over(_run()).alias("ev_sum"), F.sum("pv").over(_run()).alias("pv_sum"), F.sum("ac").over(_run()).alias("ac_sum"))
    return s.withColumns({"spi": F.when(F.col("pv_sum") > 0, F.col("ev_sum") / F.col("pv_sum")).otherwise(1.0), "cpi": F.when(F.col("ac_sum") > 0, F.col("ev_sum") / F.col("ac_sum")).otherwise(1.0)})


def what_if(remaining: DataFrame, vel: DataFrame) -> DataFrame:
    """(name, eta_weeks, delta_vs_base) of the baseline and three scenarios; no row without positive velocity."""
    mu = vel.agg(F.avg(F.when(F.col("velocity") > 0, F.col("velocity"))).alias("mu"))
    one = remaining.join(F.broadcast(mu)).where("mu > 0")
    weeks = lambda rem, v: F.ceil(F.round(rem / v, 9)).cast("double")
    r, m = F.col("remaining_effort"), F.col("mu")
    cases = [("baseline", weeks(r, m)), ("velocity+10%", weeks(r, m * 1.1)), ("velocity+25%", weeks(r, m * 1.25)), ("scope-20%", weeks(r * 0.8, m))]
    rows = F.array(*[F.struct(F.lit(n).alias("name"), c.alias("eta_weeks"), (c - cases[0][1]).alias("delta_vs_base")) for n, c in cases])
    return one.select(F.inline(rows))


def control_limits(vel: DataFrame, alpha: float = 0.3, width: float = 3.0) -> DataFrame:
    """EWMA with moving limits. The recursion folds over the ordered weekly array, which is as long as the series has weeks."""
    seq = F.array_sort(F.collect_list(F.struct("week", "velocity")))
    one = vel.agg(seq.alias("s"), F.avg("velocity").alias("mu"), F.stddev_pop("velocity").alias("sd"))
    sd = F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.greatest(F.lit(1e-6), F.col("mu") * 0.25))
    start = F.struct(F.col("mu").alias("prev"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        v = alpha * x["velocity"] + (1 - alpha) * acc["prev"]
        return F.struct(v.alias("prev"), F.array_append(acc["out"], v).alias("out"))

    folded = one.withColumns({"y": F.aggregate("s", start, step)["out"], "half": width * sd * (alpha / (2 - alpha)) ** 0.5})
    z = folded.select("half", F.explode(F.arrays_zip("s", "y")).alias("z")).select(F.col("z.s.week").alias("week"), F.col("z.s.velocity").alias("velocity"), F.col("z.y").alias("ewma"), "half")
    return z.select("week", "velocity", "ewma", (F.col("ewma") + F.col("half")).alias("ucl"), F.greatest(F.col("ewma") - F.col("half"), F.lit(0.0)).alias("lcl"))


def cusum(vel: DataFrame) -> DataFrame:
    """Two-sided CUSUM by running sums and their running extremes; alarms beyond 5 standard deviations."""
    whole = W.partitionBy()
    mu = F.avg("velocity").over(whole)
    raw = F.stddev_pop("velocity").over(whole)
    v = vel.withColumns({"mu": mu, "sd": F.when(raw > 0, raw).otherwise(F.greatest(F.lit(1e-6), mu * 0.25))})
    v = v.withColumns({"up": F.sum(F.col("velocity") - F.col("mu") - 0.5 * F.col("sd")).over(_run()), "down": F.sum(F.col("velocity") - F.col("mu") + 0.5 * F.col("sd")).over(_run())})
    v = v.withColumns({"cusum_pos": F.col("up") - F.least(F.lit(0.0), F.min("up").over(_run())), "cusum_neg": F.col("down") - F.greatest(F.lit(0.0), F.max("down").over(_run()))})
    return v.select("week", "velocity", "cusum_pos", "cusum_neg", (F.col("cusum_pos") > 5 * F.col("sd")).alias("alarm_pos"), (F.col("cusum_neg") < -5 * F.col("sd")).alias("alarm_neg"))


def risk(evm: DataFrame, tasks: DataFrame, shares: DataFrame) -> DataFrame:
    """One row (spi_last, spi_trend, overdue_rate, creep, gini, score, level): 100 times the logistic of a weighted sum.
    Without any week the score is 50.

    evm has week and spi, shares has contribution_pct; all but the shares' ranks are one-row aggregates."""
    from planloom.operators.inequality import gini

    last = evm.select("week", "spi", F.row_number().over(W.orderBy(F.desc("week"))).alias("r"), F.lag("spi").over(_week()).alias("before")).agg(
        F.max_by("spi", "week").alias("spi_last"), F.max("week").alias("latest"), F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("r") <= 3, F.col("spi") - F.col("before"))).alias("trend")
    )
    count = tasks.where(F.col("week").isNotNull()).groupBy("week").agg(F.count(F.lit(1)).alias("k")).withColumns({"r": F.row_number().over(W.orderBy(F.desc("week"))), "n": F.count(F.lit(1)).over(W.partitionBy())})
    creep = count.agg(F.avg(F.when((F.col("r") <= 3) | (F.col("n") < 3), F.col("k"))).alias("recent"), F.avg(F.when((F.col("r") > 3) | (F.col("n") <= 3), F.col("k"))).alias("prev"))
    late = tasks.join(F.broadcast(last.select("latest"))).agg((F.count_if((F.col("status") != "Completed") & (F.col("week") < F.col("latest"))) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("overdue_rate"))
    one = last.join(F.broadcast(creep)).join(F.broadcast(late)).join(F.broadcast(gini(shares, "contribution_pct")))
    one = one.select("spi_last", F.when(F.col("n") >= 4, F.col("trend")).otherwise(0.0).alias("spi_trend"), "overdue_rate", ((F.col("recent") - F.col("prev")) / F.greatest("prev", F.lit(1e-6))).alias("creep"), "gini")
    z = -1.5 * (1 - F.col("spi_last")) - F.col("overdue_rate") - 0.5 * F.greatest("creep", F.lit(0.0)) - 0.3 * F.col("gini") + 0.8 * F.col("spi_trend")
    return one.withColumn("score", F.coalesce(100 / (1 + F.exp(-z)), F.lit(50.0))).withColumn("level", risk_level(F.col("score")))


def risk_level(score: Column) -> Column:
    """Low from 70, Medium from 40, else High: a high score is a good one."""
    return F.when(score >= 70, "Low").when(score >= 40, "Medium").otherwise("High")


def kpis(tasks: DataFrame, weekly: DataFrame, eta: DataFrame) -> DataFrame:
    """One row of headline figures. tasks has project, member, effort, status; weekly has week, spi, cpi,
    velocity (infinite, missing and NaN values leave the means alone; without a value a mean is 0, without
    weeks spi and cpi are 1 and velocity 0); eta has p10, p50, p90."""
    cols = {"spi": 1.0, "cpi": 1.0, "velocity": 0.0}
    number = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    one = tasks.agg(
        F.count_distinct(F.nullif("project", F.lit(""))).alias("projects"), F.count_distinct(F.nullif("member", F.lit(""))).alias("members"), F.coalesce(F.sum("effort"), F.lit(0.0)).alias("effort_total"),
        F.coalesce(F.sum(F.when(~is_done(F.col("status")), F.col("effort"))), F.lit(0.0)).alias("effort_remaining"),
    )
    last = F.max_by(F.struct(*cols), "week")
    w = weekly.agg(F.count(F.lit(1)).alias("n"), *[F.avg(number(c)).alias(f"{c}_mean") for c in cols], last.alias("last"))
    none = F.col("n") == 0
    w = w.select(*[F.coalesce(F.col(f"{c}_mean"), F.when(none, d).otherwise(0.0)).alias(f"{c}_mean") for c, d in cols.items()], *[F.when(none, d).otherwise(F.col(f"last.{c}")).alias(f"{c}_last") for c, d in cols.items()])
    e = eta.select(*[F.coalesce(p, F.lit(0.0)).alias(f"eta_{p}") for p in ("p10", "p50", "p90")])
    # every side is one row
    j = one.join(F.broadcast(w)).join(F.broadcast(e))
    score = 50 - F.when(F.col("spi_last") < 0.9, 15).otherwise(0) - F.when(F.col("velocity_mean") < F.greatest(F.lit(1.0), 0.1 * F.col("effort_total")), 10).otherwise(0) - F.when(F.col("effort_remaining") > 0.5 * F.col("effort_total"), 10).otherwise(0)
    return j.withColumn("risk_score", score.cast("int")).withColumn("risk_level", risk_level(score))
