"""The whole analysis of a task table as a dictionary of lazy results."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.functions import text
from planloom.operators import flow, forecast, inequality, people, schedule
from planloom.plans.tasks import canonical
from planloom.session import cut
from planloom.sinks import report


def from_canonical(df: DataFrame, order: str = "row_id") -> DataFrame:
    """The operators' columns from a canonical table; weeks are made whole, duplicates of a task keep their first row."""
    t = canonical(df)
    if "week" not in [c.lower() for c in t.columns]:
        t = t.withColumn("week", F.lit(None).cast("string"))
    t = text.keep_first(text.week_numbers(t, "week", order), ["project", "task", "task_leader"], order)
    return t.select(
        F.col(order).alias("row_id"), F.col("task").alias("id"), "project", "task", F.coalesce(F.nullif(F.trim("assigned_member"), F.lit("")), F.nullif(F.trim("task_leader"), F.lit(""))).alias("leader"),
        text.list_of(F.col("assignees_list")).alias("assignees"), text.list_of(F.col("skills")).alias("skills"), F.col("effort_score").alias("effort"), F.col("planned_effort").alias("planned"), F.col("actual_cost").alias("cost"),
        F.col("week_no").alias("week"), text.status_value(F.col("completion_status")).alias("status"), text.dependencies(F.col("depends_on")).alias("depends_on"),
        "business_value", "time_criticality", "risk_reduction", "job_size", "reach", "impact", "confidence", F.col("effort").alias("own_effort"), F.col("effort_score").alias("effort_score"),
        "opt_duration", "most_duration", "pess_duration",
    )


def from_legacy(df: DataFrame) -> DataFrame:
    """A table of the older schema in canonical columns; missing efforts are estimated from the task text, three-point estimates are kept."""
    points = [c for c in df.columns if c.lower() in ("opt_duration", "most_duration", "pess_duration")]
    actual = F.when(F.col("Actual_Effort") > 0, F.col("Actual_Effort"))
    return df.select(
        "row_id", F.col("Project").alias("project"), F.col("Task").alias("task"), F.lit("").alias("assigned_member"), text.first_of(F.col("Assignees")).alias("task_leader"), F.to_json(text.list_of(F.col("Assignees"))).alias("assignees_list"),
        F.to_json(text.skill_tags(F.col("Description"))).alias("skills"), F.coalesce(actual, text.effort_estimate(F.concat_ws(" ", "Task", "Description"))).alias("effort_score"), F.col("Planned_Effort").alias("planned_effort"), F.col("Cost").alias("actual_cost"),
        F.datediff(F.substring("Week", 1, 10).try_cast("date"), F.lit("1995-01-02").cast("date")).cast("string").alias("__days"), F.col("Status").alias("completion_status"), F.lit("").alias("depends_on"),
        *points,
    ).withColumn("week", F.floor(F.col("__days").cast("int") / 7) + 1).drop("__days")


# Results with a row for each task or member: written as tables, never through the driver.
LARGE = ("07_cpm", "09_bus_factor", "10_priority", "13_contribution", "14_profiles", "15_workload", "17_hhi", "19_leaderboard", "20_lorenz")


def analyse(tasks: DataFrame) -> dict[str, DataFrame]:
    """Every result by name; nothing runs but the tables that several results share."""
    t = cut(tasks, "tasks")
    ex = people.expand_members(t)
    remaining, vel = flow.pace(t)
    deps = t.select("id", F.explode("depends_on").alias("pred"))
    plan, pert = schedule.with_estimates(t.withColumn("ordinal", F.col("row_id")), deps)
    plan = cut(plan, "plan")
    efforts = people.member_effort(ex)
    profile = people.skill_profile(ex)
    evm = flow.earned_value(t)
    eta = forecast.summarize(forecast.eta_normal(remaining, vel))
    prio = people.priority(t.select("project", "task", "business_value", "time_criticality", "risk_reduction", "job_size", "reach", "impact", "confidence", F.col("own_effort").alias("effort"), "effort_score"))
    return {
        "01_burnup": flow.burnup(t), "03_burndown": flow.burndown(t), "04_cfd": flow.cumulative_flow(t), "05_velocity": flow.control_limits(vel), "05_cusum": flow.cusum(vel), "05_forecast": forecast.velocity_forecast(vel),
        "06_evm": evm, "06_earned_schedule": flow.earned_schedule(flow.burnup(t)), "07_cpm": plan.orderBy("es", "id"), "07_cpm_cycles": plan.where(F.col("cycle_group").isNotNull()).select("cycle_group").distinct(),
        "08_pert_duration": pert, "08_eta": eta, "09_bus_factor": people.bus_factor(ex), "10_priority": prio.orderBy(F.desc_nulls_last("wsjf"), F.desc_nulls_last("rice"), "project", "task"), "11_suggestions": people.suggest(t, profile, top=50), "12_what_if": flow.what_if(remaining, vel),
        "13_contribution": people.contribution(t).orderBy(F.asc_nulls_last("project"), F.desc("contribution_pct"), "member"), "14_profiles": profile, "15_workload": people.workload(ex), "16_skill_timeline": people.skill_timeline(t),
        "17_hhi": people.concentration(people.skill_rows(ex), "member", "skill", "effort"), "18_hhi_weeks": people.week_concentration(t), "19_leaderboard": people.leaderboard(ex).orderBy("member", F.desc("score"), "skill"),
        "20_lorenz": inequality.lorenz(efforts, "member", "effort"), "21_risk": flow.risk(evm, t, people.contribution(t)),
        "22_kpis": flow.kpis(t.withColumn("member", F.col("leader")), evm, eta), "summary": summary(t, efforts, remaining, profile, eta, flow.earned_schedule(flow.burnup(t)), plan),
    }


def summary(t: DataFrame, efforts: DataFrame, remaining: DataFrame, profile: DataFrame, eta: DataFrame, es: DataFrame, plan: DataFrame) -> DataFrame:
    """One row: projects, members, efforts, inequality of members' efforts, mean skill concentration, ETA, earned schedule, critical path."""
    one = t.agg(F.count_distinct("project").alias("projects"), F.count(F.lit(1)).alias("tasks"), F.coalesce(F.sum("effort"), F.lit(0.0)).alias("effort_total"))
    hhi = people.concentration(profile, "member", "bucket", "score").agg(F.coalesce(F.avg(F.coalesce("hhi", F.lit(0.0))), F.lit(0.0)).alias("avg_skill_hhi"))
    sides = (
        efforts.agg(F.count(F.lit(1)).alias("members")), remaining, inequality.gini(efforts, "effort"), inequality.measures(efforts, "effort"), hhi, eta.select(F.coalesce("p50", F.lit(0.0)).alias("eta_p50")),
        es.agg(F.max("spi_t").alias("spi_t"), F.max("sv_t").alias("sv_t")), plan.agg(F.coalesce(F.max("ef"), F.lit(0.0)).alias("critical_duration")),
    )
    for side in sides:  # every side is one row
        one = one.join(F.broadcast(side))
    return one


def write(results: dict[str, DataFrame], folder: str, tables: bool | None = None) -> list[str]:
    """Reports as delimited files, results of unbounded size (LARGE) as tables; tables=True: all as tables, False: none.

    One result that fails doesn't stop the others; the names and reasons are written to failed.txt and returned."""
    os.makedirs(folder, exist_ok=True)
    failed = []
    for name, df in results.items():
        try:
            if name in LARGE if tables is None else tables:
                report.write_table(df, f"{folder}/{name}")
            elif name == "12_what_if":
                report.write_json(df, f"{folder}/{name}.json")
            else:
                report.write_csv(df, f"{folder}/{name}.csv")
        except Exception as e:  # noqa: BLE001
            failed.append(f"{name}: {type(e).__name__}: {str(e)[:300]}")
    if "summary" in results:
        report.text_report(results["summary"], f"{folder}/summary.txt")
    if failed:
        with open(f"{folder}/failed.txt", "w", encoding="utf-8") as f:
            f.write("\n".join(failed) + "\n")
    return failed
