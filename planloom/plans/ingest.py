"""From a raw table of text columns to the canonical task table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.functions import text
from planloom.operators import similarity
from planloom.session import cut
from planloom.sources.trackers import HINTS, role_columns

# The cost of a unit of effort, and names of date columns.
UNIT_COST = 150.0
DATE_HINTS = ("date", "ngay", "ngày", "due", "deadline", "start", "end", "created", "closed", "completed", "finish")
_DATES = ("dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "d MMM yyyy")


def _hinted(columns: list[str], hints: tuple[str, ...]) -> list[str]:
    return [c for c in columns if any(h in c.lower() for h in hints)]


def task_column(df: DataFrame, columns: list[str]) -> Column:
    """The first filled task-like column, left to right; without one the column of the longest texts."""
    named = _hinted(columns, HINTS["task"])
    if not named:
        sizes = df.agg(*[F.avg(F.length(F.trim(F.col(f"`{c}`")))).alias(f"c{i}") for i, c in enumerate(columns)]).first()
        named = [max(zip(columns, sizes), key=lambda x: x[1] or 0.0)[0]]
    found = F.coalesce(*[F.nullif(text.clean(F.col(f"`{c}`")), F.lit("")) for c in named], F.lit(""))
    return F.when(text.is_tasky(found), found).otherwise("")


def iso_weeks(df: DataFrame, dates: str, order: str) -> DataFrame:
    """df with week_no: ISO weeks of a date column, gaps filled forward and then by the first, renumbered by first appearance."""
    d = df.withColumn("__iso", F.weekofyear(dates))
    first = d.agg(F.min_by("__iso", F.when(F.col("__iso").isNotNull(), F.col(order))).alias("__first"))
    d = text.fill_forward(d, "__iso", order).join(F.broadcast(first)).withColumn("__iso", F.coalesce("__iso", "__first", F.lit(1)))
    ranks = text.first_seen_rank(d, "__iso", order)  # 53 rows at most
    return d.join(F.broadcast(ranks), "__iso").withColumn("week_no", F.col("rank").cast("int")).select(*df.columns, "week_no")


def weeks(df: DataFrame, columns: list[str], week: str | None, order: str = "row_id") -> DataFrame:
    """df with week_no: a week column with a number in it, else the first date-like column that can be read
    in at least 3 rows and a fifth of all, else the row's number."""
    if week and not df.where(text.to_number(F.col(f"`{week}`")).isNotNull()).isEmpty():
        return text.week_numbers(df.withColumn("__week", F.col(f"`{week}`")), "__week", order).drop("__week")
    n = df.count()
    for c in _hinted(columns, DATE_HINTS):
        day = F.coalesce(*[F.try_to_timestamp(F.trim(F.col(f"`{c}`")), F.lit(f)) for f in _DATES])
        dated = df.withColumn("__day", day)
        if dated.where(F.col("__day").isNotNull()).count() >= max(3, n // 5):
            return iso_weeks(dated, "__day", order).drop("__day")
    return text.week_numbers(df.withColumn("__week", F.lit(None).cast("string")), "__week", order).drop("__week")


def status_column(df: DataFrame, columns: list[str], status: str | None) -> DataFrame:
    """df with state: a done-like column gives Completed or Not Started; else the status text in three states,
    reduced to two when nothing is in progress and fewer than three states occur."""
    done = _hinted(columns, HINTS["done"])
    if done:
        hit = F.greatest(*[text.detect_done(F.col(f"`{c}`")).cast("int") for c in done], F.lit(0)) > 0
        return df.withColumn("state", F.when(hit, "Completed").otherwise("Not Started"))
    if status is None:
        return df.withColumn("state", F.lit("Not Started"))
    d = df.withColumn("state", text.status_value(F.col(f"`{status}`")))
    flags = d.agg((F.count_if(F.col("state") == "In Progress") > 0).alias("__some"), F.count_distinct("state").alias("__kinds"))
    keep = F.col("__some") | (F.col("__kinds") >= 3)
    return d.join(F.broadcast(flags)).withColumn("state", F.when(keep | (F.col("state") == "Completed"), F.col("state")).otherwise("Not Started")).drop("__some", "__kinds")


def merge_members(df: DataFrame, columns: list[str], lists: list[str], threshold: float = 0.92) -> DataFrame:
    """df with the names in columns, and in array columns, replaced by their group's canonical name."""
    names = None
    for c in (*columns, *lists):
        part = df.select((F.explode(c) if c in lists else F.col(c)).alias("name"))
        names = part if names is None else names.unionByName(part)
    mapped = cut(similarity.greedy_groups(names.distinct(), "name", threshold).select("name", "canonical"), "canonical")
    out = df
    for c in columns:
        out = out.join(mapped.select(F.col("name").alias(c), F.col("canonical").alias("__to")), c, "left").withColumn(c, F.coalesce("__to", c)).drop("__to")
    for c in lists:
        long = out.select("row_id", F.posexplode(c).alias("__at", "name")).join(mapped, "name", "left")
        back = long.groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", F.coalesce("canonical", "name").alias("v")))), lambda x: x["v"]).alias("__list"))
        out = out.join(back, "row_id", "left").withColumn(c, F.coalesce("__list", c)).drop("__list")
    return out.select(*df.columns)


def build_tasks(df: DataFrame, title: str = "", order: str = "row_id", merge: bool = True) -> DataFrame:
    """The canonical table of a raw one: rows without a task text of two letters or without a lead are dropped,
    of equal (project, task, lead) the first stays, and members' spellings are merged, in the lists too."""
    columns = [c for c in df.columns if c != order]
    role = role_columns(columns)
    col = lambda r: F.coalesce(F.col(f"`{role[r]}`"), F.lit("")) if r in role else F.lit("")
    d = df.withColumn("__task", task_column(df, columns)).withColumn("__team", text.split_people(col("assignee")))
    d = d.where((F.length("__task") >= 2) & (F.size("__team") > 0))
    d = cut(weeks(status_column(d, columns, role.get("status")), columns, role.get("week"), order), "raw")
    effort = F.bround(text.effort_estimate(F.col("__task")), 2)
    number = lambda r: text.to_number(col(r)) if r in role else F.lit(None).cast("double")
    out = d.select(
        F.col(order).alias("row_id"), F.coalesce(F.nullif(F.trim(col("project")), F.lit("")), F.lit(title)).alias("project"), F.col("__task").alias("task"), F.element_at("__team", 1).alias("assigned_member"),
        F.element_at("__team", 1).alias("task_leader"), F.col("__team").alias("assignees_list"), F.to_json(text.task_skills(F.col("__task"))).alias("skills"), effort.alias("effort_score"),
        F.bround(F.coalesce(number("planned"), effort), 2).alias("planned_effort"), F.bround(F.coalesce(number("cost"), effort * UNIT_COST), 2).alias("actual_cost"), F.col("week_no").alias("week"),
        F.col("state").alias("completion_status"), text.clean(col("depends")).alias("depends_on"),
    )
    out = cut(text.keep_first(out, ["project", "task", "task_leader"], "row_id"), "tasks")
    if merge:
        out = merge_members(out, ["assigned_member", "task_leader"], ["assignees_list"])
    return out.withColumn("assignees_list", F.to_json("assignees_list"))

