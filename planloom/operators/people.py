"""Members, skills and their links: expansion, profiles, concentration, contribution, assignment."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Buckets of skill labels; labels are compared in lower case, unknown ones are General.
BUCKETS: dict[str, tuple[str, ...]] = {
    "Frontend & Design": ("Frontend", "Design", "UI/UX"),
    "Backend": ("Backend",),
    "DevOps & Security": ("DevOps", "Security"),
    "Data & AI": ("Data/AI",),
    "QA & Testing": ("Testing/QA", "QA"),
    "Mobile": ("Mobile",),
    "PM & Strategy": ("Product/PM", "PM", "Strategy", "Biz", "Growth", "Content"),
    "Research & Insights": ("Research", "Market Research"),
    "General": ("General", "Documentation", "Support"),
}


def bucket_of(skill: Column, buckets: dict[str, tuple[str, ...]] | None = None) -> Column:
    table = {label.lower(): b for b, labels in (buckets or BUCKETS).items() for label in labels}
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, F.lower(F.trim(skill))), F.lit("General"))


def expand_members(tasks: DataFrame, split: bool = False) -> DataFrame:
    """One row per task and member: the assignee list, else the leader; tasks without either are left out.

    Effort counts in full for every member; with `split` it is divided among them."""
    team = F.coalesce(F.when(F.size("assignees") > 0, F.col("assignees")), F.when(F.length(F.trim("leader")) > 0, F.array("leader")))
    t = tasks.withColumn("__team", team)
    if split:
        t = t.withColumn("effort", F.col("effort") / F.size("__team"))
    return t.select(*tasks.columns, F.explode("__team").alias("member"))


def member_effort(expanded: DataFrame) -> DataFrame:
    return expanded.groupBy("member").agg(F.sum("effort").alias("effort"), F.count(F.lit(1)).alias("n_tasks"))


def workload(expanded: DataFrame) -> DataFrame:
    """Long form of the member x week heat map."""
    return expanded.where(F.col("week").isNotNull()).groupBy("member", "week").agg(F.sum("effort").alias("effort"))


def skill_rows(expanded: DataFrame) -> DataFrame:
    """One row per task, member and skill; effort 0 or missing counts 1."""
    e = F.when(F.coalesce("effort", F.lit(0.0)) == 0, 1.0).otherwise(F.col("effort"))
    return expanded.select("task", "member", "week", e.alias("effort"), F.explode("skills").alias("skill"))


def skill_matrix(expanded: DataFrame) -> DataFrame:
    """Long form of the member x skill heat map."""
    return skill_rows(expanded).groupBy("member", "skill").agg(F.sum("effort").alias("effort"))


def skill_profile(expanded: DataFrame, buckets: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(member, bucket, score): effort by bucket as a percentage of the member's largest, 2 decimals half-even."""
    by = skill_rows(expanded).groupBy("member", bucket_of(F.col("skill"), buckets).alias("bucket")).agg(F.sum("effort").alias("effort"))
    most = F.max("effort").over(W.partitionBy("member"))
    return by.select("member", "bucket", F.bround(F.when(most > 0, F.col("effort") / most * 100).otherwise(0.0), 2).alias("score"))


def concentration(rows: DataFrame, by: str, of: str, value: str) -> DataFrame:
    """(by, hhi): sum of squared shares of `of` within each `by`."""
    s = rows.groupBy(by, of).agg(F.sum(value).alias("v"))
    return s.groupBy(by).agg((F.sum(F.col("v") * F.col("v")) / (F.sum("v") * F.sum("v"))).alias("hhi"))


def week_concentration(tasks: DataFrame) -> DataFrame:
    """HHI of skills by week; tasks without skills count as General."""
    skills = F.when(F.size("skills") > 0, F.col("skills")).otherwise(F.array(F.lit("General")))
    return concentration(tasks.select("week", "effort", F.explode(skills).alias("skill")), "week", "skill", "effort")


def skill_timeline(tasks: DataFrame) -> DataFrame:
    return tasks.select("week", F.coalesce("effort", F.lit(1.0)).alias("effort"), F.explode("skills").alias("skill")).groupBy("week", "skill").agg(F.sum("effort").alias("effort"))


def skill_flow(expanded: DataFrame, top_skills: int = 6, top_members: int = 8) -> DataFrame:
    """Skill-member efforts among the top skills and members by effort (ties by name)."""
    m = skill_matrix(expanded)
    s = m.groupBy("skill").agg(F.sum("effort").alias("e")).orderBy(F.desc("e"), "skill").limit(top_skills).select("skill")
    t = m.groupBy("member").agg(F.sum("effort").alias("e")).orderBy(F.desc("e"), "member").limit(top_members).select("member")
    return m.join(F.broadcast(s), "skill", "left_semi").join(F.broadcast(t), "member", "left_semi").select("skill", "member", "effort")


def bus_factor(expanded: DataFrame) -> DataFrame:
    """(member, degree_tasks, solo_tasks, solo_share, key_person_index)."""
    pairs = expanded.select("task", "member").distinct()
    per = pairs.groupBy("task").agg(F.count(F.lit(1)).alias("mpt"))
    d = pairs.join(per, "task").groupBy("member").agg(F.count(F.lit(1)).cast("double").alias("degree_tasks"), F.count_if(F.col("mpt") == 1).cast("double").alias("solo_tasks"))
    most = d.agg(F.greatest(F.max("degree_tasks"), F.lit(1.0)).alias("most"))
    share = F.col("solo_tasks") / F.col("degree_tasks")
    return d.join(F.broadcast(most)).select("member", "degree_tasks", "solo_tasks", share.alias("solo_share"), (0.7 * share + 0.3 * F.col("degree_tasks") / F.col("most")).alias("key_person_index"))


def bipartite(expanded: DataFrame) -> DataFrame:
    return expanded.select("member", "task", F.coalesce("effort", F.lit(1.0)).alias("effort"))


def contribution(tasks: DataFrame, samples: int = 1) -> DataFrame:
    """(project, member, value, contribution_pct): every marginal of the proportional game is value / n,
    so shares need no sampling; `samples` > 1 weights teams as summed samples would."""
    n = F.size("assignees")
    v = F.col("effort") * F.when(n > 1, float(samples)).otherwise(1.0) / n
    rows = tasks.where((n > 0) & (F.col("effort") > 0)).select("project", v.alias("v"), F.explode("assignees").alias("member"))
    s = rows.groupBy("project", "member").agg(F.sum("v").alias("value"))
    return s.withColumn("contribution_pct", 100 * F.col("value") / F.sum("value").over(W.partitionBy("project")))


def leaderboard(expanded: DataFrame) -> DataFrame:
    """(member, skill, score): effort per skill as a percentage of the member's best skill."""
    m = expanded.select("member", F.coalesce("effort", F.lit(0.0)).alias("effort"), F.explode("skills").alias("skill")).groupBy("member", "skill").agg(F.sum("effort").alias("effort"))
    most = F.max("effort").over(W.partitionBy("member"))
    return m.select("member", "skill", (100 * F.col("effort") / F.when(most > 0, most).otherwise(1.0)).alias("score"))


def suggest(tasks: DataFrame, profile: DataFrame, per_task: int = 3, top: int | None = None, buckets: dict[str, tuple[str, ...]] | None = None, needs_at_once: int = 2000) -> DataFrame:
    """(task, member, score): the members whose profile is closest to a task's skills by cosine.

    Tasks share few label sets. Members are one row each (their scores by bucket) and stay where they
    are; the distinct label sets are a query set, taken in blocks of `needs_at_once` against all
    members, and each batch of members keeps its best few per set, so what is shuffled are those, not
    sets x members. Members whose score is 0 are not suggested; ties go to the smaller name."""
    labels = F.array_sort(F.transform(F.when(F.size("skills") > 0, F.col("skills")).otherwise(F.array(F.lit("General"))), lambda s: bucket_of(s, buckets)))
    want = tasks.select("task", F.array_join(labels, "\x01").alias("need"))
    members = profile.groupBy("member").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "score"))).alias("has")).where(F.col("member").isNotNull())  # a bucket occurs once a member
    blocks: list[list[str]] = [[]]
    for r in want.select("need").distinct().orderBy("need").toLocalIterator():
        if len(blocks[-1]) == needs_at_once:
            blocks.append([])
        blocks[-1].append(r.need)
    found = reduce(DataFrame.unionByName, [members.mapInPandas(_closest(b, per_task), "need string, member string, score double") for b in blocks])
    best = found.withColumn("r", F.row_number().over(W.partitionBy("need").orderBy(F.desc("score"), "member"))).where(F.col("r") <= per_task).drop("r")
    out = want.join(best, "need").select("task", "member", "score")
    return out if top is None else out.orderBy(F.desc("score"), "task", "member").limit(top)


def _closest(needs: list[str], k: int):  # noqa: ANN202
    """Per batch of members the k best of each need (ties included by name)."""
    parts = [n.split("\x01") for n in needs]
    names = sorted({b for p in parts for b in p})
    at = {b: i for i, b in enumerate(names)}
    n = np.zeros((len(needs), len(names)))
    for i, p in enumerate(parts):
        for b in p:
            n[i, at[b]] += 1
    norm = np.sqrt((n * n).sum(axis=1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            who = batch["member"].to_numpy(dtype=object)
            has = [dict(x) for x in batch["has"]]
            size = np.array([math.sqrt(sum(v * v for v in h.values())) for h in has])
            dots = np.zeros((len(needs), len(who)))
            for b, j in at.items():
                dots += n[:, j : j + 1] * np.array([h.get(b, 0.0) for h in has])
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.where(dots > 0, np.round(dots / (norm[:, None] * size[None, :]), 9), 0.0)
            rows = []
            for i, need in enumerate(needs):
                s = score[i]
                edge = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else 0.0
                good = np.flatnonzero((s >= edge) & (s > 0))
                rows += [(need, who[j], s[j]) for j in sorted(good, key=lambda j: (-s[j], who[j]))[:k]]
            yield pd.DataFrame(rows, columns=["need", "member", "score"])

    return run


def priority(tasks: DataFrame) -> DataFrame:
    """(project, task, wsjf, rice) of canonical tasks; missing inputs take their defaults, and a size
    column that is empty throughout is replaced by the next one."""
    flags = tasks.agg(F.count("job_size").alias("n_size"), F.count("effort").alias("n_effort"))
    d = tasks.join(F.broadcast(flags))
    size = F.when(F.col("n_size") > 0, F.coalesce("job_size", F.lit(1.0))).otherwise(F.coalesce("effort_score", F.lit(1.0)))
    effort = F.when(F.col("n_effort") > 0, F.coalesce("effort", F.lit(1.0))).otherwise(F.coalesce("job_size", F.lit(1.0)))
    gain = F.coalesce("business_value", F.lit(1.0)) + F.coalesce("time_criticality", F.lit(1.0)) + F.coalesce("risk_reduction", F.lit(1.0))
    reach = F.coalesce("reach", F.lit(1.0)) * F.coalesce("impact", F.lit(1.0)) * F.coalesce("confidence", F.lit(0.7))
    return d.select("project", "task", (gain / F.greatest(size, F.lit(0.1))).alias("wsjf"), (reach / F.greatest(effort, F.lit(0.1))).alias("rice"))
