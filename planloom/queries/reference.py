"""Queries of the project-control operators and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planloom.functions import text
from planloom.operators import flow, forecast, inequality, people, schedule, similarity
from planloom.plans.tasks import TASKS_SQL, canonical, order_tasks
from planloom.session import cut, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TYPE_BUCKETS = {"Frontend & Design": ("ECONOMY", "STANDARD"), "Backend": ("PROMO",), "Data & AI": ("LARGE",)}

_T = "WITH " + TASKS_SQL
_WEEKS = _T + """,
wk AS (SELECT week, sum(effort) AS scope, sum(CASE WHEN status = 'Completed' THEN effort ELSE 0 END) AS completed FROM tasks GROUP BY week),
bu AS (SELECT week, sum(scope) OVER (ORDER BY week) AS scope_cumulative, sum(completed) OVER (ORDER BY week) AS completed_cumulative FROM wk),
vel AS (SELECT week, greatest(completed_cumulative - coalesce(lag(completed_cumulative) OVER (ORDER BY week), 0), 0) AS velocity FROM bu),
rem AS (SELECT coalesce(sum(CASE WHEN status <> 'Completed' THEN effort END), 0) AS remaining_effort FROM tasks)"""
_EXP = _T + """,
ex AS (SELECT task, project, week, effort, skills, status, unnest(CASE WHEN len(assignees) > 0 THEN assignees ELSE [leader] END) AS member FROM tasks),
sk AS (SELECT task, member, week, CASE WHEN effort = 0 THEN 1.0 ELSE effort END AS effort, unnest(skills) AS skill FROM ex)"""
_ME = _EXP + ", me AS (SELECT member, sum(effort) AS effort, count(*) AS n_tasks FROM ex GROUP BY member)"
_BUCKET = """CASE WHEN skill IN ('ECONOMY', 'STANDARD') THEN 'Frontend & Design' WHEN skill = 'PROMO' THEN 'Backend' WHEN skill = 'LARGE' THEN 'Data & AI' ELSE 'General' END"""


def query(sql: str | None = None, name: str | None = None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


FLOW = ("week", "effort", "status")


def _expanded(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return people.expand_members(order_tasks(spark, sf_dir, "leader", "assignees", *columns))


def _velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.velocity(order_tasks(spark, sf_dir, *FLOW))


def _pace(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return flow.pace(order_tasks(spark, sf_dir, *FLOW))


def r9(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# Weekly flow


@query(_WEEKS + " SELECT * FROM bu")
def burnup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.burnup(order_tasks(spark, sf_dir, *FLOW))


@query(_WEEKS + " SELECT week, scope_cumulative - completed_cumulative AS remaining_effort FROM bu")
def burndown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.burndown(order_tasks(spark, sf_dir, *FLOW))


_CFD = _T + """ SELECT week, sum(n) OVER w AS not_started, sum(p) OVER w AS in_progress, sum(c) OVER w AS completed FROM (
  SELECT week, sum(CASE WHEN status = 'Not Started' THEN effort ELSE 0 END) AS n, sum(CASE WHEN status = 'In Progress' THEN effort ELSE 0 END) AS p,
         sum(CASE WHEN status = 'Completed' THEN effort ELSE 0 END) AS c FROM tasks GROUP BY week) WINDOW w AS (ORDER BY week)"""


@query(_CFD)
def cfd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.cumulative_flow(order_tasks(spark, sf_dir, *FLOW))


@query(_CFD)
def cfd_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.binned_flow(order_tasks(spark, sf_dir, *FLOW))


@query(_WEEKS + " SELECT week, scope AS total_effort, completed AS completed_effort, greatest(sum(scope - completed) OVER (ORDER BY week), 0.0) AS remaining_effort FROM wk")
def burndown_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.burndown_detail(order_tasks(spark, sf_dir, *FLOW))


@query(_WEEKS + """, s AS (SELECT week, sum(sum(effort)) OVER (ORDER BY week) AS scope_cumulative FROM tasks GROUP BY week),
c AS (SELECT week, sum(sum(effort)) OVER (ORDER BY week) AS c FROM tasks WHERE status = 'Completed' GROUP BY week)
SELECT s.week, scope_cumulative, coalesce(last_value(c IGNORE NULLS) OVER (ORDER BY s.week), 0.0) AS completed_cumulative FROM s LEFT JOIN c ON s.week = c.week""")
def burnup_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.burnup_filled(order_tasks(spark, sf_dir, *FLOW))


@query(_WEEKS + " SELECT * FROM vel")
def velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _velocity(spark, sf_dir)


@query(_WEEKS + " SELECT * FROM rem")
def remaining_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.remaining_effort(order_tasks(spark, sf_dir, *FLOW))


@query(_WEEKS + """, st AS (SELECT avg(velocity) AS mu, CASE WHEN stddev_pop(velocity) > 0 THEN stddev_pop(velocity) ELSE greatest(1e-6, avg(velocity) / 4) END AS sd FROM vel),
n AS (SELECT week, velocity, row_number() OVER (ORDER BY week) AS i FROM vel),
e AS (SELECT a.week, any_value(a.velocity) AS velocity, power(0.7, any_value(a.i)) * any_value(mu) + sum(0.3 * power(0.7, a.i - b.i) * b.velocity) AS ewma, any_value(sd) AS sd
      FROM n a JOIN n b ON b.i <= a.i CROSS JOIN st GROUP BY a.week)
SELECT week, velocity, round(ewma, 6) AS ewma, round(ewma + 3 * sd * sqrt(0.3 / 1.7), 6) AS ucl, round(greatest(ewma - 3 * sd * sqrt(0.3 / 1.7), 0), 6) AS lcl FROM e""")
def control_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r9(flow.control_limits(_velocity(spark, sf_dir)), "ewma", "ucl", "lcl")


@query(_WEEKS + """, st AS (SELECT avg(velocity) AS mu, CASE WHEN stddev_pop(velocity) > 0 THEN stddev_pop(velocity) ELSE greatest(1e-6, avg(velocity) / 4) END AS sd FROM vel),
r AS (SELECT week, velocity, sd, sum(velocity - mu - sd / 2) OVER (ORDER BY week) AS u, sum(velocity - mu + sd / 2) OVER (ORDER BY week) AS d FROM vel CROSS JOIN st),
c AS (SELECT week, velocity, sd, u - least(0, min(u) OVER (ORDER BY week)) AS p, d - greatest(0, max(d) OVER (ORDER BY week)) AS n FROM r)
SELECT week, velocity, round(p, 4) AS cusum_pos, round(n, 4) AS cusum_neg, p > 5 * sd AS alarm_pos, n < -5 * sd AS alarm_neg FROM c""")
def control_cusum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r9(flow.cusum(_velocity(spark, sf_dir)), "cusum_pos", "cusum_neg", digits=4)


@query(_WEEKS + """, n AS (SELECT week, scope_cumulative AS pv, lead(scope_cumulative) OVER (ORDER BY week) AS pv1, lead(week) OVER (ORDER BY week) AS week1, row_number() OVER (ORDER BY week) AS i FROM bu),
o AS (SELECT arg_max(completed_cumulative, week) AS ev, max(week) AS "at", count(*) AS n FROM bu),
k AS (SELECT ev, "at", greatest(least((SELECT count(*) FROM n WHERE pv <= ev) - 1, n - 2), 0) AS idx FROM o),
e AS (SELECT week + (ev - pv) / (pv1 - pv) * (week1 - week) AS es, CAST("at" AS DOUBLE) AS "at" FROM n JOIN k ON i = idx + 1)
SELECT round(es, 6) AS es, "at", round(es - "at", 6) AS sv_t, round(es / "at", 6) AS spi_t FROM e""")
def earned_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r9(flow.earned_schedule(flow.burnup(order_tasks(spark, sf_dir, *FLOW))), "es", "sv_t", "spi_t")


@query(_T + """, w AS (SELECT week, coalesce(sum(CASE WHEN status = 'Completed' THEN effort END), 0) AS ev, sum(planned) AS pv, sum(cost) AS ac, count(*) FILTER (status = 'Completed') AS n_done FROM tasks GROUP BY week),
s AS (SELECT week, n_done, ev AS velocity, sum(ev) OVER (ORDER BY week) AS e, CAST(sum(pv) OVER (ORDER BY week) AS DOUBLE) AS p, CAST(sum(ac) OVER (ORDER BY week) AS DOUBLE) AS a FROM w)
SELECT week, n_done, velocity, round(e, 4) AS ev_sum, round(p, 4) AS pv_sum, round(a, 2) AS ac_sum, round(CASE WHEN p > 0 THEN e / p ELSE 1 END, 6) AS spi, round(CASE WHEN a > 0 THEN e / a ELSE 1 END, 9) AS cpi FROM s""")
def evm_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = flow.earned_value(order_tasks(spark, sf_dir, *FLOW, "planned", "cost"))
    return r9(r9(r9(e, "ev_sum", "pv_sum", digits=4), "ac_sum", digits=2), "spi").withColumn("cpi", F.round("cpi", 9))


_WHAT = """, mu AS (SELECT avg(velocity) FILTER (velocity > 0) AS mu FROM vel),
b AS (SELECT remaining_effort AS r, mu AS m, ceil(round(remaining_effort / mu, 9)) AS base FROM rem CROSS JOIN mu WHERE mu > 0)
SELECT 'baseline' AS name, base AS eta_weeks, 0.0 AS delta_vs_base FROM b
UNION ALL SELECT 'velocity+10%', ceil(round(r / (m * 1.1::DOUBLE), 9)), ceil(round(r / (m * 1.1::DOUBLE), 9)) - base FROM b
UNION ALL SELECT 'velocity+25%', ceil(round(r / (m * 1.25::DOUBLE), 9)), ceil(round(r / (m * 1.25::DOUBLE), 9)) - base FROM b
UNION ALL SELECT 'scope-20%', ceil(round(r * 0.8::DOUBLE / m, 9)), ceil(round(r * 0.8::DOUBLE / m, 9)) - base FROM b"""


@query(_WEEKS + _WHAT)
def what_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.what_if(*_pace(spark, sf_dir))


# Members and skills


@query(_EXP + " SELECT task, project, week, effort, status, member FROM ex")
def member_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expanded(spark, sf_dir, "task", "project", "week", "effort", "status").select("task", "project", "week", "effort", "status", "member")


@query(_ME + " SELECT * FROM me")
def member_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.member_effort(_expanded(spark, sf_dir, "effort"))


@query(_EXP + " SELECT member, week, sum(effort) AS effort FROM ex GROUP BY member, week")
def workload_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.workload(_expanded(spark, sf_dir, "week", "effort"))


@query(_EXP + " SELECT member, skill, sum(effort) AS effort FROM sk GROUP BY member, skill")
def skill_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.skill_matrix(_expanded(spark, sf_dir, "task", "week", "effort", "skills"))


@query(_EXP + f", b AS (SELECT member, {_BUCKET} AS bucket, sum(effort) AS e FROM sk GROUP BY 1, 2) SELECT member, bucket, round_even(e / max(e) OVER (PARTITION BY member) * 100, 2) AS score FROM b")
def skill_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.skill_profile(_expanded(spark, sf_dir, "task", "week", "effort", "skills"), TYPE_BUCKETS)


@query(_EXP + ", b AS (SELECT member, skill, sum(effort) AS e FROM sk GROUP BY 1, 2) SELECT member, round(sum(e * e) / (sum(e) * sum(e)), 9) AS hhi FROM b GROUP BY member")
def skill_hhi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r9(people.concentration(people.skill_rows(_expanded(spark, sf_dir, "task", "week", "effort", "skills")), "member", "skill", "effort"), "hhi", digits=9)


@query(_T + """, b AS (SELECT week, unnest(CASE WHEN len(skills) > 0 THEN skills ELSE ['General'] END) AS skill, effort FROM tasks),
c AS (SELECT week, skill, sum(effort) AS e FROM b GROUP BY 1, 2) SELECT week, round(sum(e * e) / (sum(e) * sum(e)), 9) AS hhi FROM c GROUP BY week""")
def hhi_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r9(people.week_concentration(order_tasks(spark, sf_dir, "week", "effort", "skills")), "hhi", digits=9)


@query(_T + " SELECT week, skill, sum(effort) AS effort FROM (SELECT week, effort, unnest(skills) AS skill FROM tasks) GROUP BY week, skill")
def skill_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.skill_timeline(order_tasks(spark, sf_dir, "week", "effort", "skills"))


@query(_EXP + """, m AS (SELECT member, skill, sum(effort) AS effort FROM sk GROUP BY 1, 2)
SELECT skill, member, effort FROM m WHERE skill IN (SELECT skill FROM m GROUP BY 1 ORDER BY sum(effort) DESC, 1 LIMIT 6) AND member IN (SELECT member FROM m GROUP BY 1 ORDER BY sum(effort) DESC, 1 LIMIT 8)""")
def skill_flow_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.skill_flow(_expanded(spark, sf_dir, "task", "week", "effort", "skills"))


@query(_EXP + """, p AS (SELECT DISTINCT task, member FROM ex), q AS (SELECT member, task, count(*) OVER (PARTITION BY task) AS mpt FROM p),
d AS (SELECT member, CAST(count(*) AS DOUBLE) AS degree_tasks, CAST(count(*) FILTER (mpt = 1) AS DOUBLE) AS solo_tasks FROM q GROUP BY member)
SELECT member, degree_tasks, solo_tasks, round(solo_tasks / degree_tasks, 9) AS solo_share, round(0.7 * (solo_tasks / degree_tasks) + 0.3 * degree_tasks / (SELECT max(degree_tasks) FROM d), 9) AS key_person_index FROM d""")
def bus_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r9(people.bus_factor(_expanded(spark, sf_dir, "task")), "solo_share", "key_person_index", digits=9)


@query(_EXP + " SELECT member, task, effort FROM ex")
def bipartite_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.bipartite(_expanded(spark, sf_dir, "task", "effort"))


@query(_T + """, r AS (SELECT project, unnest(assignees) AS member, effort / len(assignees) AS v FROM tasks WHERE len(assignees) > 0 AND effort > 0),
s AS (SELECT project, member, sum(v) AS value FROM r GROUP BY 1, 2) SELECT project, member, round(value, 6) AS value, round(100 * value / sum(value) OVER (PARTITION BY project), 6) AS contribution_pct FROM s""")
def shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r9(people.contribution(order_tasks(spark, sf_dir, "project", "assignees", "effort")), "value", "contribution_pct")


@query(_EXP + ", m AS (SELECT member, skill, sum(effort) AS e FROM (SELECT member, effort, unnest(skills) AS skill FROM ex) GROUP BY 1, 2) SELECT member, skill, round(100 * e / max(e) OVER (PARTITION BY member), 6) AS score FROM m")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r9(people.leaderboard(_expanded(spark, sf_dir, "effort", "skills")), "score")


@query(_EXP + f""", b AS (SELECT member, {_BUCKET} AS bucket, sum(effort) AS e FROM sk GROUP BY 1, 2),
prof AS (SELECT member, bucket, round_even(e / max(e) OVER (PARTITION BY member) * 100, 2) AS score FROM b),
tl AS (SELECT task, unnest(CASE WHEN len(skills) > 0 THEN skills ELSE ['General'] END) AS skill FROM tasks),
tb AS (SELECT task, {_BUCKET} AS bucket, CAST(count(*) AS DOUBLE) AS n FROM tl GROUP BY 1, 2),
need AS (SELECT task, string_agg(bucket || ':' || n, ',' ORDER BY bucket) AS need FROM tb GROUP BY 1),
nb AS (SELECT DISTINCT need, bucket, n FROM need JOIN tb USING (task)),
dots AS (SELECT need, member, sum(n * score) AS dot FROM nb JOIN prof USING (bucket) GROUP BY 1, 2),
sc AS (SELECT d.need, d.member, round(dot / ((SELECT sqrt(sum(n * n)) FROM nb WHERE nb.need = d.need) * (SELECT sqrt(sum(score * score)) FROM prof WHERE prof.member = d.member)), 9) AS score FROM dots d WHERE dot > 0),
best AS (SELECT *, row_number() OVER (PARTITION BY need ORDER BY score DESC, member) AS r FROM sc)
SELECT task, member, score FROM need JOIN best USING (need) WHERE r <= 3""")
def assign_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = cut(order_tasks(spark, sf_dir, "task", "leader", "assignees", "skills", "effort", "week"), "tasks")
    return people.suggest(t, people.skill_profile(people.expand_members(t), TYPE_BUCKETS), buckets=TYPE_BUCKETS)


_CLEAN = "CASE WHEN isnan({0}) THEN NULL ELSE {0} END"
_PRIO = "SELECT row_id, project, task, " + ", ".join(
    f"{_CLEAN.format(c)} AS {c}" for c in ("effort_score", "job_size", "effort", "business_value", "time_criticality", "risk_reduction", "reach", "impact", "confidence")
) + " FROM external_input"


@query(f"WITH t AS ({_PRIO}) SELECT row_id, round((coalesce(business_value, 1) + coalesce(time_criticality, 1) + coalesce(risk_reduction, 1)) / greatest(coalesce(job_size, 1), 0.1), 9) AS wsjf FROM t")
def wsjf(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = canonical(read(spark, sf_dir, "external_input")).withColumn("task", F.col("row_id"))
    return people.priority(t).select(F.col("task").alias("row_id"), F.round("wsjf", 9).alias("wsjf"))


@query(f"WITH t AS ({_PRIO}) SELECT row_id, round(coalesce(reach, 1) * coalesce(impact, 1) * coalesce(confidence, 0.7) / greatest(coalesce(effort, 1), 0.1), 9) AS rice FROM t")
def rice(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = canonical(read(spark, sf_dir, "external_input")).withColumn("task", F.col("row_id"))
    return people.priority(t).select(F.col("task").alias("row_id"), F.round("rice", 9).alias("rice"))


# Inequality


def _efforts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.member_effort(_expanded(spark, sf_dir, "effort"))


@query(_ME + ", n AS (SELECT effort AS x, row_number() OVER (ORDER BY effort) AS i, count(*) OVER () AS n FROM me) SELECT round(2 * sum(i * x) / (max(n) * sum(x)) - (max(n) + 1.0) / max(n), 9) AS gini FROM n")
def gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r9(inequality.gini(_efforts(spark, sf_dir), "effort"), "gini", digits=9)


_MEAN = _ME + ", j AS (SELECT effort AS x, avg(effort) OVER () AS mu FROM me) SELECT "


@query(_MEAN + """round(avg(x / mu * ln(x / mu)) FILTER (x > 0), 9) AS theil_t, round(avg(ln(mu / x)) FILTER (x > 0), 9) AS theil_l,
round(1 - power(avg(sqrt(x)), 2) / avg(x), 9) AS atkinson, round(0.5 * avg(abs(x - mu)) / avg(mu), 9) AS hoover FROM j""")
def inequality_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r9(inequality.measures(_efforts(spark, sf_dir), "effort"), "theil_t", "theil_l", "atkinson", "hoover", digits=9)


@query(_EXP + """, d AS (SELECT project AS g, sum(effort) AS x FROM ex GROUP BY project, member), q AS (SELECT g, x, avg(x) OVER () AS mu, avg(x) OVER (PARTITION BY g) AS mg, sum(x) OVER () AS t FROM d),
b AS (SELECT g, sum(x) AS s, avg(x / mg * ln(x / mg)) AS tg, max(t) AS t FROM q GROUP BY g)
SELECT (SELECT round(avg(x / mu * ln(x / mu)), 9) FROM q) AS t_total, round(avg(s / (t / n) * ln(s / (t / n))), 9) AS t_between, round(sum(s / t * tg), 9) AS t_within FROM b CROSS JOIN (SELECT count(*) AS n FROM b)""")
def theil_decomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _expanded(spark, sf_dir, "project", "effort").groupBy("project", "member").agg(F.sum("effort").alias("effort"))
    return r9(inequality.theil_decomposition(d, "project", "effort"), "t_total", "t_between", "t_within", digits=9)


@query(_ME + " SELECT row_number() OVER w AS rank, round(row_number() OVER w / count(*) OVER (), 9) AS population_share, round(sum(effort) OVER w / sum(effort) OVER (), 9) AS value_share FROM me WINDOW w AS (ORDER BY effort, member ROWS UNBOUNDED PRECEDING)")
def lorenz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r9(inequality.lorenz(_efforts(spark, sf_dir), "member", "effort"), "population_share", "value_share", digits=9)


@query("WITH q AS (SELECT quantile_cont(o_totalprice, 0.05) AS a, quantile_cont(o_totalprice, 0.95) AS b FROM orders) SELECT o_orderkey, round(least(greatest(o_totalprice, a), b), 4) AS o_totalprice_w FROM orders CROSS JOIN q")
def winsorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inequality.winsorize(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", F.round("o_totalprice_w", 4).alias("o_totalprice_w"))


@query("""WITH RECURSIVE r AS (SELECT 0 AS i, (SELECT median(o_totalprice) FROM orders) AS mu, false AS stop UNION ALL
SELECT i + 1, CASE WHEN abs(new - mu) < 1e-6 THEN mu ELSE new END, abs(new - mu) < 1e-6 FROM (SELECT i, mu, sum(w * x) / sum(w) AS new FROM (
  SELECT i, mu, x, least(1.0, 1.345 * (s + 1e-6) / (abs(x - mu) + 1e-6)) AS w FROM (SELECT i, mu, o_totalprice AS x, median(abs(o_totalprice - mu)) OVER () AS s FROM r CROSS JOIN orders WHERE NOT stop AND i < 50)) GROUP BY i, mu))
SELECT round(arg_max(mu, i), 4) AS huber_mean FROM r""")
def huber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r9(inequality.huber_mean(read(spark, sf_dir, "orders"), "o_totalprice"), "huber_mean", digits=4)


# Text

_TIDY = "trim(regexp_replace(coalesce({0}, ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


@query("SELECT row_id, array_to_string(list_filter(list_transform(regexp_split_to_array(" + _TIDY.format("assignees") + ", '[+;,/|&]+'), lambda x: trim(x)), lambda x: x <> ''), '~') AS people FROM legacy_tasks")
def assignee_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "legacy_tasks").select("row_id", F.array_join(text.split_people(F.col("assignees")), "~").alias("people"))


def _like(s: str, parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({s}, '{p}')" for p in parts) + ")"


def _in(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


@query(f"WITH t AS (SELECT row_id, lower({_TIDY.format('completion_status')}) AS s FROM external_input) SELECT row_id, CASE WHEN s IN {_in(text.NOT_STARTED_WORDS)} THEN 'Not Started' WHEN {_like('s', text.PROGRESS_PARTS)} THEN 'In Progress' WHEN {_like('s', text.DONE_PARTS)} THEN 'Completed' ELSE 'In Progress' END AS state FROM t")
def status_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "external_input").select("row_id", text.status_value(F.col("completion_status")).alias("state"))


@query(f"SELECT row_id, s IN {_in(text.DONE_WORDS)} OR {_like('s', ('done', 'hoàn thành', 'hoan thanh', 'completed', 'xong', '100%'))} AS done FROM (SELECT row_id, lower(trim(coalesce(completion_status, ''))) AS s FROM external_input)")
def done_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "external_input").select("row_id", text.detect_done(F.col("completion_status")).alias("done"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Completed' ELSE 'In Progress' END AS status FROM orders WHERE o_orderstatus IN ('F', 'O')")
def status_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O")).select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "done").otherwise("to do").alias("status"))
    return text.collapsed_status(o, "status")


_WORDS = " + ".join(f"CAST(contains(t, '{w}') AS INTEGER)" for w in text.EFFORT_WORDS)


@query(f"WITH d AS (SELECT row_id, lower(coalesce(task, '')) AS t FROM legacy_tasks), e AS (SELECT row_id, greatest(1.0, least(10.0, len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')) / 6.0)) AS base, {_WORDS} AS hits FROM d) SELECT row_id, round(greatest(1.0, least(10.0, base + 0.8 * hits)), 6) AS effort FROM e")
def effort_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "legacy_tasks").select("row_id", F.round(text.effort_estimate(F.col("task")), 6).alias("effort"))


def _tag(tag: str, words: tuple[str, ...]) -> str:
    return "CASE WHEN " + _like("t", tuple(f" {w} " for w in words)) + f" THEN '{tag}' END"


@query("WITH d AS (SELECT row_id, ' ' || regexp_replace(lower(coalesce(task, '')), '\\s+', ' ', 'g') || ' ' AS t FROM legacy_tasks) SELECT row_id, array_to_string(list_sort(list_filter([" + ", ".join(_tag(k, v) for k, v in text.SKILL_TAGS.items()) + "], lambda x: x IS NOT NULL)), ',') AS tags FROM d")
def skill_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "legacy_tasks").select("row_id", F.array_join(text.skill_tags(F.col("task")), ",").alias("tags"))


def _hits(label: str) -> str:
    return " + ".join(f"len(regexp_extract_all(t, '(?i){p}'))" for p in text.SKILL_PATTERNS[label])


_SERVES = f"(({_hits('Frontend')}) > 0 AND (contains(t, 'api') OR contains(t, 'service') OR contains(t, 'backend')))"
_TRIAL = "(contains(t, 'ab test') OR contains(t, 'ab-test') OR contains(t, 'experiment') OR contains(t, 'thí nghiệm') OR contains(t, 'thi nghiem'))"
_PLUS = {
    "Backend": f"CASE WHEN {_SERVES} THEN 0.5 ELSE 0 END", "Data/AI": f"CASE WHEN {_TRIAL} THEN 0.5 ELSE 0 END", "Product/PM": f"CASE WHEN {_TRIAL} THEN 0.5 ELSE 0 END",
    "DevOps": f"CASE WHEN (({_hits('Backend')}) > 0 OR {_SERVES}) AND (contains(t, 'deploy') OR contains(t, 'docker') OR contains(t, 'k8s') OR contains(t, 'triển khai') OR contains(t, 'trien khai')) THEN 0.5 ELSE 0 END",
    "Security": "CASE WHEN contains(t, 'bảo mật') OR contains(t, 'bao mat') OR contains(t, 'security') OR contains(t, 'auth') OR contains(t, 'jwt') OR contains(t, 'sso') THEN 0.75 ELSE 0 END",
}
_SKILLS = "WITH d AS (SELECT row_id, lower(" + _TIDY.format("task") + ") AS t FROM legacy_tasks), s AS (" + " UNION ALL ".join(
    f"SELECT row_id, {i} AS i, '{label}' AS label, {_hits(label)} + {_PLUS.get(label, '0')} AS score FROM d" for i, label in enumerate(text.SKILL_PATTERNS)
) + """), r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, i) AS r FROM s WHERE score > 0)
SELECT row_id, coalesce(string_agg(label, ',' ORDER BY r.r) FILTER (r.r <= 4), 'General') AS labels FROM d LEFT JOIN r USING (row_id) GROUP BY row_id"""


@query(_SKILLS)
def skill_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "legacy_tasks").select("row_id", F.array_join(text.task_skills(F.col("task")), ",").alias("labels"))


@query("SELECT row_id, CAST(greatest(coalesce(last_value(week IGNORE NULLS) OVER (ORDER BY row_id), 1), 1) AS INTEGER) AS week_no FROM external_input")
def week_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.week_numbers(read(spark, sf_dir, "external_input"), "week", "row_id").select("row_id", "week_no")


@query("SELECT week, row_number() OVER (ORDER BY f, week) AS rank FROM (SELECT week, min(row_id) AS f FROM legacy_tasks WHERE week IS NOT NULL GROUP BY week)")
def week_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.first_seen_rank(read(spark, sf_dir, "legacy_tasks"), "week", "row_id")


@query("SELECT row_id, task, project FROM (SELECT *, row_number() OVER (PARTITION BY project, task, task_leader ORDER BY row_id) AS r FROM external_input) WHERE r = 1")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.keep_first(read(spark, sf_dir, "external_input").select("row_id", "task", "project", "task_leader"), ["project", "task", "task_leader"], "row_id").select("row_id", "task", "project")


@query("WITH n AS (SELECT DISTINCT lower(p_name) AS p_name FROM part) SELECT a.p_name AS name_a, b.p_name AS name_b, round(jaro_winkler_similarity(a.p_name, b.p_name), 6) AS sim FROM n a JOIN n b ON a.p_name < b.p_name WHERE round(jaro_winkler_similarity(a.p_name, b.p_name), 9) >= 0.92")
def jw_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "part").select(F.lower("p_name").alias("p_name"))
    return r9(similarity.similar_pairs(n, "p_name"), "sim")


_CLUSTERS = """n AS (SELECT DISTINCT p_name AS name FROM part WHERE trim(p_name) <> ''), p AS (SELECT a.name AS a, b.name AS b FROM n a JOIN n b ON a.name <> b.name AND round(jaro_winkler_similarity(lower(a.name), lower(b.name)), 9) >= 0.92),
o AS (SELECT name, row_number() OVER (ORDER BY length(name), name) AS i FROM (SELECT DISTINCT a AS name FROM p)),
r AS (SELECT 0 AS i, CAST([] AS VARCHAR[]) AS seeds UNION ALL
  SELECT r.i + 1, CASE WHEN len(list_filter(seeds, lambda s: round(jaro_winkler_similarity(lower(s), lower(name)), 9) >= 0.92)) > 0 THEN seeds ELSE list_append(seeds, name) END FROM r JOIN o ON o.i = r.i + 1),
f AS (SELECT arg_max(seeds, i) AS seeds FROM r),
g AS (SELECT name, list_filter(seeds, lambda s: s = name OR round(jaro_winkler_similarity(lower(s), lower(name)), 9) >= 0.92)[1] AS seed FROM o CROSS JOIN f UNION ALL SELECT name, name FROM n WHERE name NOT IN (SELECT name FROM o)),
c AS (SELECT seed, arg_min(name, (abs(length(name) - 10), length(regexp_replace(name, '[A-Za-zÀ-ỹ ]', '', 'g')), name)) AS canonical FROM g GROUP BY seed)"""


@query("WITH RECURSIVE " + _CLUSTERS + " SELECT name, seed, canonical FROM g JOIN c USING (seed)")
def name_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.greedy_groups(read(spark, sf_dir, "part"), "p_name")


# Schedule


def _order_graph(spark: SparkSession, sf_dir: str, circles: bool = False) -> tuple[DataFrame, DataFrame]:
    """A customer's orders by date form a heap: each waits for the one at half its place."""
    t = order_tasks(spark, sf_dir, "id", "effort", "customer", "dated").select(F.col("id"), F.col("effort").alias("dur"), F.col("id").alias("ordinal"), "customer", F.row_number().over(W.partitionBy("customer").orderBy("dated", "id")).alias("rn"))
    up = t.select("customer", F.col("rn").alias("half"), F.col("id").alias("pred"))
    deps = t.withColumn("half", F.floor(F.col("rn") / 2).cast("int")).join(up, ["customer", "half"]).select("pred", "id")
    if circles:
        pair = t.where("rn <= 2 and customer % 10 = 0").groupBy("customer").agg(F.max_by("id", "rn").alias("pred"), F.min_by("id", "rn").alias("id"), F.count(F.lit(1)).alias("n")).where("n = 2")
        deps = deps.unionByName(pair.select("pred", "id"))
    return t.select("id", "dur", "ordinal"), deps


@query(_T + """, n AS (SELECT id, effort AS dur, customer, row_number() OVER (PARTITION BY customer ORDER BY dated, id) AS rn FROM tasks),
f AS (SELECT id, customer, rn, dur, dur AS ef FROM n WHERE rn = 1)
, lv AS (WITH RECURSIVE r AS (SELECT id, customer, rn, dur, dur AS ef FROM n WHERE rn = 1 UNION ALL SELECT n.id, n.customer, n.rn, n.dur, r.ef + n.dur FROM n JOIN r ON n.customer = r.customer AND n.rn // 2 = r.rn AND n.rn > 1) SELECT * FROM r)
, up AS (WITH RECURSIVE u AS (SELECT id, customer, rn, rn AS at, dur AS t FROM n UNION ALL SELECT u.id, u.customer, u.rn, n.rn AS at, u.t + n.dur FROM u JOIN n ON n.customer = u.customer AND n.rn // 2 = u.at AND n.rn > 1) SELECT id, max(t) AS tail FROM u GROUP BY id)
SELECT lv.id, ef - dur AS es, ef, d - tail AS ls, d - tail + dur AS lf, dur AS duration, d - tail - (ef - dur) AS slack, abs(d - tail - (ef - dur)) < 1e-9 AS critical
FROM lv JOIN up ON lv.id = up.id CROSS JOIN (SELECT max(ef) AS d FROM lv)""")
def cpm_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.critical_path(*_order_graph(spark, sf_dir))


_RELAXED = """, n AS (SELECT id, effort AS dur, customer, row_number() OVER (PARTITION BY customer ORDER BY dated, id) AS rn FROM tasks),
e AS (SELECT u.id AS a, n.id AS b FROM n JOIN n u ON n.customer = u.customer AND u.rn = n.rn // 2 WHERE n.rn > 1 UNION SELECT x.id, y.id FROM n x JOIN n y ON x.customer = y.customer AND x.rn = 2 AND y.rn = 1 WHERE x.customer % 10 = 0),
k AS (WITH RECURSIVE r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT * FROM r),
c AS (SELECT n.id, coalesce((SELECT max(x.b) FROM k x JOIN k y ON x.a = y.b AND x.b = y.a WHERE x.a = n.id), n.id) AS comp, dur FROM n),
b AS (SELECT comp, sum(dur) AS dur, count(*) AS n, string_agg(id, ' -> ' ORDER BY id) AS named FROM c GROUP BY comp),
g AS (SELECT DISTINCT x.comp AS a, y.comp AS b FROM e JOIN c x ON e.a = x.id JOIN c y ON e.b = y.id WHERE x.comp <> y.comp),
lv AS (WITH RECURSIVE r AS (SELECT comp, dur, dur AS ef FROM b WHERE comp NOT IN (SELECT b FROM g) UNION ALL SELECT b.comp, b.dur, r.ef + b.dur FROM r JOIN g ON g.a = r.comp JOIN b ON b.comp = g.b) SELECT comp, max(ef) AS ef FROM r GROUP BY comp),
up AS (WITH RECURSIVE u AS (SELECT comp, comp AS at, dur AS t FROM b UNION ALL SELECT u.comp, b.comp, u.t + b.dur FROM u JOIN g ON g.a = u.at JOIN b ON b.comp = g.b) SELECT comp, max(t) AS tail FROM u GROUP BY comp),
l AS (SELECT b.comp, b.n, b.named, ef - dur AS es, (SELECT max(ef) FROM lv) - tail - (ef - dur) AS slack FROM b JOIN lv USING (comp) JOIN up USING (comp)),
m AS (SELECT c.id, c.dur, l.n, l.named, l.slack, l.es + coalesce(sum(c.dur) OVER (PARTITION BY c.comp ORDER BY c.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS es FROM c JOIN l USING (comp))
SELECT id, es, es + dur AS ef, es + slack AS ls, es + slack + dur AS lf, dur AS duration, slack, abs(slack) < 1e-9 AS critical, CASE WHEN n > 1 THEN named END AS cycle_group FROM m"""


@query(_T + _RELAXED)
def cpm_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.relaxed_path(*_order_graph(spark, sf_dir, circles=True))


@query()
def pert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The input's tasks by their three-point estimates where given, else by their effort."""
    t = canonical(read(spark, sf_dir, "external_input")).select(F.col("task").alias("id"), F.col("row_id").alias("ordinal"), F.col("effort_score").alias("effort"), "opt_duration", "most_duration", "pess_duration", "depends_on")
    deps = t.select("id", F.explode(text.dependencies(F.col("depends_on"))).alias("pred"))
    return schedule.with_estimates(t, deps)[1]


@query()
def pert_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks, deps = _order_graph(spark, sf_dir)
    plan = schedule.critical_path(tasks, deps)
    t = tasks.withColumns({c: F.lit(None).cast("double") for c in ("o", "m", "p")})
    return schedule.pert_samples(t.select("id", *schedule.durations("dur", "o", "m", "p")), plan)


# Forecasts


_DRAWN = _WEEKS + """, st AS (SELECT avg(velocity) FILTER (velocity > 0) AS mu, stddev_pop(velocity) FILTER (velocity > 0) AS sd FROM vel),
u AS (SELECT t AS trial, (CAST('0x' || substr(md5('42-' || t || 'a'), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS a, (CAST('0x' || substr(md5('42-' || t || 'b'), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS b FROM range(2000) r(t)),
w AS (SELECT ceil(round(remaining_effort / greatest(mu + sd * (sqrt(-2 * ln(a)) * cos(2 * pi() * b)), 1e-6), 6)) AS weeks FROM u CROSS JOIN st CROSS JOIN rem)"""


@query(_DRAWN + " SELECT quantile_cont(weeks, 0.1) AS p10, quantile_cont(weeks, 0.5) AS p50, quantile_cont(weeks, 0.9) AS p90 FROM w")
def eta_hash_mc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.summarize(forecast.eta_normal(*_pace(spark, sf_dir)))


@query(_WEEKS + """, v AS (SELECT list(velocity ORDER BY week) AS v FROM vel),
d AS (SELECT t, w, greatest(v[CAST(floor((CAST('0x' || substr(md5('42-' || t || '-' || w), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE * len(v)) AS INTEGER) + 1], 0.1) AS x FROM range(5000) r(t) CROSS JOIN range(1, 105) s(w) CROSS JOIN v),
c AS (SELECT t, w, sum(x) OVER (PARTITION BY t ORDER BY w) AS s FROM d),
f AS (SELECT t, coalesce(min(w) FILTER (s >= remaining_effort), 104) AS weeks FROM c CROSS JOIN rem GROUP BY t)
SELECT CAST(quantile_cont(weeks, 0.1) AS DOUBLE) AS p10, CAST(quantile_cont(weeks, 0.5) AS DOUBLE) AS p50, CAST(quantile_cont(weeks, 0.9) AS DOUBLE) AS p90 FROM f""")
def eta_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.summarize(forecast.eta_bootstrap(*_pace(spark, sf_dir)))


@query(_DRAWN + """, s AS (SELECT min(weeks) AS lo, max(weeks) AS hi, CAST(least(30, greatest(6, floor(sqrt(count(*))))) AS INTEGER) AS bins FROM w),
b AS (SELECT lo, CASE WHEN hi > lo THEN (hi - lo) / bins ELSE 1.0 END AS width, bins FROM s),
c AS (SELECT CAST(least(floor((weeks - lo) / width), bins - 1) AS INTEGER) AS bin, lo, width FROM w CROSS JOIN b)
SELECT bin, round(lo + bin * width, 6) AS low, round(lo + (bin + 1) * width, 6) AS high, count(*) AS n FROM c GROUP BY bin, lo, width""")
def eta_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r9(forecast.histogram(forecast.eta_normal(*_pace(spark, sf_dir))), "low", "high")


@query(_WEEKS + " SELECT step, m AS mean FROM (SELECT round(avg(velocity), 6) AS m FROM (SELECT velocity FROM vel ORDER BY week DESC LIMIT 5)) CROSS JOIN range(1, 17) r(step)")
def ma_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r9(forecast.moving_average(_velocity(spark, sf_dir)), "mean")


@query(_WEEKS + """, v AS (SELECT velocity AS x, row_number() OVER (ORDER BY week) AS i FROM vel),
h AS (WITH RECURSIVE r AS (SELECT a, b, CAST(2 AS BIGINT) AS i, p.x AS level, q.x - p.x AS trend, 0.0::DOUBLE AS err, 0 AS k FROM (SELECT a / 100.0::DOUBLE AS a FROM range(5, 100, 5) t(a)) CROSS JOIN (SELECT b / 100.0::DOUBLE AS b FROM range(0, 100, 5) t(b)) CROSS JOIN v p CROSS JOIN v q WHERE p.i = 1 AND q.i = 2
  UNION ALL SELECT a, b, r.i + CASE WHEN k = 0 THEN 0 ELSE 1 END, level + trend + a * (x - (level + trend)), trend + a * b * (x - (level + trend)), err + power(x - (level + trend), 2), k + 1 FROM r JOIN v ON v.i = k + 2) SELECT * FROM r),
z AS (SELECT level, trend FROM h WHERE k = (SELECT max(k) FROM h) ORDER BY err, a, b LIMIT 1),
m AS (SELECT 1 / (median(velocity) + 1e-9) AS eta FROM (SELECT velocity FROM vel ORDER BY week DESC LIMIT 8))
SELECT step, round(greatest(level + trend * step, 0), 4) AS mean, round(eta, 9) AS eta_p50 FROM z CROSS JOIN m CROSS JOIN range(1, 17) r(step)""")
def velocity_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r9(r9(forecast.velocity_forecast(_velocity(spark, sf_dir)), "mean", digits=4), "eta_p50", digits=9)


@query()
def anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.anomalies(read(spark, sf_dir, "weekly_evm").select("evm_id", "project", "week", "velocity"), "velocity", ["evm_id"])


@query()
def effort_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "legacy_tasks").select("row_id", "description", F.when(~F.isnan("actual_effort"), F.col("actual_effort")).alias("actual_effort"))
    return forecast.effort_model(t, "description", "actual_effort").select("row_id", "effort_p10", "effort_p50", "effort_p90")


@query()
def effort_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each older task's effort: the actual one, else the model's."""
    t = read(spark, sf_dir, "legacy_tasks").select("row_id", "description", F.when(~F.isnan("actual_effort"), F.col("actual_effort")).alias("actual_effort"))
    return forecast.attach_effort(t, "description", "actual_effort").select("row_id", "effort_score")


# Reports


@query("""WITH w AS (SELECT project, week, evm_id, CASE WHEN isnan(spi) THEN NULL ELSE spi END AS spi, CASE WHEN isnan(cpi) THEN NULL ELSE cpi END AS cpi, CASE WHEN isnan(velocity) THEN NULL ELSE velocity END AS velocity FROM weekly_evm),
l AS (SELECT project, row_number() OVER (PARTITION BY project ORDER BY week DESC, evm_id DESC) AS r, spi, cpi, velocity FROM w)
SELECT m.project, n_weeks, round(spi_mean, 6) AS spi_mean, round(cpi_mean, 6) AS cpi_mean, round(velocity_mean, 6) AS velocity_mean, spi AS spi_last, cpi AS cpi_last, velocity AS velocity_last
FROM (SELECT project, count(*) AS n_weeks, avg(spi) AS spi_mean, avg(cpi) AS cpi_mean, avg(velocity) AS velocity_mean FROM w GROUP BY project) m JOIN l ON m.project = l.project AND r = 1""")
def kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and last values of the weekly indicators of each project; the last row of a week is its latest."""
    cols = ["spi", "cpi", "velocity"]
    w = read(spark, sf_dir, "weekly_evm").select("project", "week", "evm_id", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in cols]).where(F.col("project").isNotNull())
    last = F.max_by(F.struct(*cols), F.struct("week", "evm_id"))
    g = w.groupBy("project").agg(F.count(F.lit(1)).alias("n_weeks"), *[F.round(F.avg(c), 6).alias(f"{c}_mean") for c in cols], last.alias("l"))
    return g.select("project", "n_weeks", *[f"{c}_mean" for c in cols], *[F.col(f"l.{c}").alias(f"{c}_last") for c in cols])


_SUMMARY = _DRAWN.replace(_T, _EXP, 1) + """, me AS (SELECT member, sum(effort) AS effort FROM ex GROUP BY member), rk AS (SELECT effort AS x, row_number() OVER (ORDER BY effort) AS i, count(*) OVER () AS n, avg(effort) OVER () AS mu FROM me),
pb AS (SELECT member, """ + _BUCKET + """ AS bucket, sum(effort) AS e FROM sk GROUP BY 1, 2), pf AS (SELECT member, round_even(e / max(e) OVER (PARTITION BY member) * 100, 2) AS score FROM pb),
hh AS (SELECT avg(h) AS h FROM (SELECT sum(score * score) / (sum(score) * sum(score)) AS h FROM pf GROUP BY member)),
sn AS (SELECT week, scope_cumulative AS pv, lead(scope_cumulative) OVER (ORDER BY week) AS pv1, lead(week) OVER (ORDER BY week) AS week1, row_number() OVER (ORDER BY week) AS i FROM bu),
so AS (SELECT arg_max(completed_cumulative, week) AS ev, max(week) AS "at", count(*) AS n FROM bu),
si AS (SELECT ev, "at", greatest(least((SELECT count(*) FROM sn WHERE pv <= ev) - 1, n - 2), 0) AS idx FROM so),
es AS (SELECT week + (ev - pv) / (pv1 - pv) * (week1 - week) AS es, CAST("at" AS DOUBLE) AS "at" FROM sn JOIN si ON i = idx + 1),
hn AS (SELECT id, effort AS dur, customer, row_number() OVER (PARTITION BY customer ORDER BY dated, id) AS rn FROM tasks),
cp AS (WITH RECURSIVE r AS (SELECT customer, rn, dur AS ef FROM hn WHERE rn = 1 UNION ALL SELECT hn.customer, hn.rn, r.ef + hn.dur FROM hn JOIN r ON hn.customer = r.customer AND hn.rn // 2 = r.rn AND hn.rn > 1) SELECT max(ef) AS duration FROM r)
SELECT (SELECT count(DISTINCT project) FROM tasks) AS projects, (SELECT count(*) FROM me) AS members, (SELECT count(*) FROM tasks) AS tasks, (SELECT sum(effort) FROM tasks) AS effort_total, (SELECT remaining_effort FROM rem) AS remaining_effort,
(SELECT quantile_cont(weeks, 0.5) FROM w) AS eta_p50, (SELECT round(h, 6) FROM hh) AS avg_skill_hhi, (SELECT round(es / "at", 6) FROM es) AS spi_t, (SELECT round(es - "at", 6) FROM es) AS sv_t, (SELECT duration FROM cp) AS critical_duration,
round(2 * sum(i * x) / (max(n) * sum(x)) - (max(n) + 1.0) / max(n), 6) AS gini, round(avg(x / mu * ln(x / mu)), 6) AS theil_t, round(avg(ln(mu / x)), 6) AS theil_l, round(1 - power(avg(sqrt(x)), 2) / avg(x), 6) AS atkinson, round(0.5 * avg(abs(x - mu)) / avg(mu), 6) AS hoover FROM rk"""


@query(_SUMMARY)
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one-row summary of a run."""
    from planloom.plans import pipeline

    t = cut(order_tasks(spark, sf_dir, "task", "project", "leader", "assignees", "skills", "effort", "week", "status"), "tasks")
    ex = people.expand_members(t)
    remaining, vel = flow.pace(t)
    eta = forecast.summarize(forecast.eta_normal(remaining, vel))
    plan = schedule.critical_path(*_order_graph(spark, sf_dir))
    one = pipeline.summary(t, people.member_effort(ex), remaining, people.skill_profile(ex, TYPE_BUCKETS), eta, flow.earned_schedule(flow.burnup(t)), plan)
    return r9(one, "avg_skill_hhi", "spi_t", "sv_t", "gini", "theil_t", "theil_l", "atkinson", "hoover")


_KPIS = _DRAWN + """, ew AS (SELECT week, coalesce(sum(CASE WHEN status = 'Completed' THEN effort END), 0) AS ev, sum(planned) AS pv, sum(cost) AS ac FROM tasks GROUP BY week),
ec AS (SELECT week, ev, sum(ev) OVER (ORDER BY week) AS e, CAST(sum(pv) OVER (ORDER BY week) AS DOUBLE) AS p, CAST(sum(ac) OVER (ORDER BY week) AS DOUBLE) AS a FROM ew),
el AS (SELECT week, ev AS velocity, CASE WHEN p > 0 THEN e / p ELSE 1 END AS spi, CASE WHEN a > 0 THEN e / a ELSE 1 END AS cpi FROM ec),
k AS (SELECT (SELECT count(DISTINCT project) FROM tasks) AS projects, (SELECT count(DISTINCT leader) FROM tasks) AS members, (SELECT sum(effort) FROM tasks) AS effort_total, (SELECT remaining_effort FROM rem) AS effort_remaining, avg(spi) AS spi_mean, avg(cpi) AS cpi_mean,
  avg(velocity) AS velocity_mean, arg_max(spi, week) AS spi_last, arg_max(cpi, week) AS cpi_last, arg_max(velocity, week) AS velocity_last FROM el),
z AS (SELECT *, 50 - CASE WHEN spi_last < 0.9 THEN 15 ELSE 0 END - CASE WHEN velocity_mean < greatest(1, 0.1 * effort_total) THEN 10 ELSE 0 END - CASE WHEN effort_remaining > 0.5 * effort_total THEN 10 ELSE 0 END AS risk_score FROM k)
SELECT projects, members, effort_total, effort_remaining, round(spi_mean, 6) AS spi_mean, round(cpi_mean, 9) AS cpi_mean, round(velocity_mean, 6) AS velocity_mean, round(spi_last, 6) AS spi_last, round(cpi_last, 9) AS cpi_last, velocity_last,
(SELECT quantile_cont(weeks, 0.1) FROM w) AS eta_p10, (SELECT quantile_cont(weeks, 0.5) FROM w) AS eta_p50, (SELECT quantile_cont(weeks, 0.9) FROM w) AS eta_p90, risk_score, CASE WHEN risk_score >= 70 THEN 'Low' WHEN risk_score >= 40 THEN 'Medium' ELSE 'High' END AS risk_level FROM z"""


@query(_KPIS)
def kpi_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headline figures of a whole run."""
    t = cut(order_tasks(spark, sf_dir, "project", "leader", "effort", "planned", "cost", "week", "status"), "tasks")
    eta = forecast.summarize(forecast.eta_normal(*flow.pace(t)))
    k = flow.kpis(t.withColumn("member", F.col("leader")), flow.earned_value(t), eta)
    return r9(r9(k, "spi_mean", "velocity_mean", "spi_last"), "cpi_mean", "cpi_last", digits=9)


@query(_T + """, w AS (SELECT week, sum(CASE WHEN status = 'Completed' THEN effort ELSE 0 END) AS ev, sum(planned) AS pv, count(*) AS k FROM tasks GROUP BY week),
s AS (SELECT week, k, sum(ev) OVER (ORDER BY week) / CAST(sum(pv) OVER (ORDER BY week) AS DOUBLE) AS spi, row_number() OVER (ORDER BY week DESC) AS r FROM w),
r AS (SELECT project, unnest(assignees) AS member, effort / len(assignees) AS v FROM tasks WHERE len(assignees) > 0 AND effort > 0),
c AS (SELECT 100 * sum(v) / sum(sum(v)) OVER (PARTITION BY project) AS x FROM r GROUP BY project, member), ci AS (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n FROM c),
o AS (SELECT (SELECT spi FROM s WHERE r = 1) AS a, (SELECT (max(spi) FILTER (r = 1) - max(spi) FILTER (r = 4)) / 3 FROM s) AS t,
  (SELECT count(*) FILTER (status <> 'Completed' AND week < (SELECT max(week) FROM tasks)) / CAST(count(*) AS DOUBLE) FROM tasks) AS d,
  (SELECT (avg(k) FILTER (r <= 3) - avg(k) FILTER (r > 3)) / avg(k) FILTER (r > 3) FROM s) AS p, (SELECT 2 * sum(i * x) / (max(n) * sum(x)) - (max(n) + 1.0) / max(n) FROM ci) AS g)
SELECT round(a, 6) AS spi_last, round(t, 6) AS spi_trend, round(d, 6) AS overdue_rate, round(p, 6) AS creep, round(g, 6) AS gini,
round(100 / (1 + exp(-(-1.5 * (1 - a) - d - 0.5 * greatest(p, 0) - 0.3 * g + 0.8 * t))), 4) AS score, CASE WHEN 100 / (1 + exp(-(-1.5 * (1 - a) - d - 0.5 * greatest(p, 0) - 0.3 * g + 0.8 * t))) >= 70 THEN 'Low' WHEN 100 / (1 + exp(-(-1.5 * (1 - a) - d - 0.5 * greatest(p, 0) - 0.3 * g + 0.8 * t))) >= 40 THEN 'Medium' ELSE 'High' END AS level FROM o""")
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = cut(order_tasks(spark, sf_dir, "project", "assignees", "effort", "planned", "cost", "week", "status"), "tasks")
    return r9(r9(flow.risk(flow.earned_value(t), t, people.contribution(t)), "spi_last", "spi_trend", "overdue_rate", "creep", "gini"), "score", digits=4)


@query("""SELECT row_id, rank AS week_no FROM (SELECT row_id, week(loaded_at) AS w FROM legacy_tasks) JOIN (SELECT w, row_number() OVER (ORDER BY f) AS rank FROM (SELECT week(loaded_at) AS w, min(row_id) AS f FROM legacy_tasks GROUP BY 1)) USING (w)""")
def week_from_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planloom.plans import ingest

    return ingest.iso_weeks(read(spark, sf_dir, "legacy_tasks").select("row_id", "loaded_at"), "loaded_at", "row_id").select("row_id", "week_no")


# Sources and streams


def _hint(cells: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({cells}, '{w}')" for w in words) + ")"


# Names of the older schema, with the words that stand for them, and the hints of a workbook's header.
_NAMES = {
    "task": ("task", "title", "name", "issue", "card", "subject"), "project": ("project", "board", "repo", "space"), "description": ("description", "desc", "body", "details", "content"),
    "assignees": ("assignees", "assignee", "owner", "members", "assigned_to"), "status": ("status", "state", "stage", "column", "list"), "week": ("week", "date", "due", "deadline", "created", "updated"),
}
_SHEET_HINTS = (
    "task", "nhiệm vụ", "nhiem vu", "mô tả", "mo ta", "description", "công việc", "cong viec", "title", "issue", "work item", "assigned", "assignee", "người đảm nhận", "nguoi dam nhan", "owner", "phụ trách", "phu trach",
    "nguoi lam", "assigned to", "người làm", "week", "tuần", "chi tiết tuần", "chi tiet tuan", "sprint", "iteration", "check", "done", "hoàn thành", "hoan thanh", "xong", "100%", "status", "trạng thái", "trang thai",
    "giai đoạn", "giai doan", "progress", "tiến độ", "tinh trang", "planned effort", "công sức ước tính", "cong suc uoc tinh", "estimate", "ước tính", "effort", "sp", "story point", "complexity", "actual cost", "chi phí",
    "chi phi", "cost", "ac", "thực chi", "budget", "project", "dự án", "du an", "depends", "phụ thuộc", "phu thuoc", "dependency", "precedence",
)
_CELLS = """WITH l AS (SELECT file_id, line_no, payload FROM staged_lines WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
c AS (SELECT file_id, 2 * (line_no - (SELECT min(line_no) FROM staged_lines)) AS row_idx, json_keys(payload) AS cells FROM l
  UNION ALL SELECT file_id, 2 * (line_no - (SELECT min(line_no) FROM staged_lines)) + 1, list_transform(json_keys(payload), lambda k: json_extract_string(payload, '$."' || k || '"')) FROM l),
t AS (SELECT file_id, row_idx, list_transform(list_filter(cells, lambda x: x IS NOT NULL), lambda x: lower(trim(x))) AS low, lower(array_to_string(list_transform(cells, lambda x: coalesce(trim(x), '')), ' ')) AS line,
  list_aggregate(list_transform(cells, lambda x, i: CASE WHEN trim(x) <> '' THEN i END), 'max') AS filled FROM c),
s AS (SELECT 'shared' AS form, file_id, row_idx, """ + " + ".join(
    f"CASE WHEN list_contains(low, '{n}') THEN 2 WHEN len(list_filter(low, lambda x: {_hint('x', w)})) > 0 THEN 1 ELSE 0 END" for n, w in _NAMES.items()
) + " AS score FROM t WHERE row_idx < 30 UNION ALL SELECT 'workbook', file_id, row_idx, " + " + ".join(f"CAST(contains(line, '{h}') AS INTEGER)" for h in _SHEET_HINTS) + """ + CASE WHEN filled >= 3 THEN 1 ELSE 0 END FROM t WHERE row_idx < 200 AND filled IS NOT NULL)
SELECT form, file_id, CAST(arg_min(row_idx, (-score, row_idx)) AS INTEGER) AS header_row, max(score) AS score FROM s GROUP BY form, file_id"""


@query(_CELLS)
def header_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header rows of the staged files read as sheets: each readable line gives a row of its names and a row of its values."""
    from planloom.sources import trackers

    raw = read(spark, sf_dir, "staged_lines")
    low = raw.agg(F.min("line_no").alias("low"))
    lines = raw.select("file_id", "line_no", "payload", F.try_parse_json("payload").alias("doc")).where(F.schema_of_variant("doc").startswith("OBJECT")).join(F.broadcast(low))
    keys = F.json_object_keys("payload")
    values = F.from_json("payload", "map<string,string>")
    at = (F.col("line_no") - F.col("low")) * 2
    both = F.array(F.struct(at.alias("row_idx"), keys.alias("cells")), F.struct((at + 1).alias("row_idx"), F.transform(keys, lambda k: F.try_element_at(values, k)).alias("cells")))
    cells = lines.select(F.lit("staged").alias("path"), F.col("file_id").cast("string").alias("sheet"), F.inline(both))
    found = trackers.detect_headers(cells).withColumn("form", F.lit("shared")).unionByName(trackers.find_headers(cells).withColumn("form", F.lit("workbook")))
    return found.select("form", F.col("sheet").cast("long").alias("file_id"), "header_row", F.col("score").cast("int").alias("score"))


@query("SELECT CAST(row_id AS VARCHAR) AS row_id, " + ", ".join(f"nullif({c}, '') AS {c}" for c in ("task", "project", "description", "assignees", "status", "week")) + ", CAST(cost AS VARCHAR) AS cost FROM legacy_tasks WHERE cost IS NULL OR NOT isnan(cost)")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older table (without NaN costs, which engines spell differently) written as delimited text and read back: quotes, line breaks and blanks stay, empty texts are null."""
    t = read(spark, sf_dir, "legacy_tasks").where(F.col("cost").isNull() | ~F.isnan("cost")).select(F.col("row_id").alias("row"), "task", "project", "description", "assignees", "status", "week", "cost")
    back = _as_csv(spark, t.select(*[F.col(c).cast("string").alias(c) for c in t.columns]))
    return back.select(F.col("row").alias("row_id"), *t.columns[1:])


def _as_csv(spark: SparkSession, df: DataFrame) -> DataFrame:
    import uuid

    from planloom.session import shared_dir
    from planloom.sources import trackers

    path = f"{shared_dir(spark)}/planloom/csv-{uuid.uuid4().hex[:12]}"
    df.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return trackers.read_csv(spark, path)


@query("""SELECT 'Board' AS "Project", coalesce(task, '') AS "Task", nullif(description, '') AS "Description", nullif(assignees, '') AS "Assignees", nullif(status, '') AS "Status",
strftime(date_trunc('week', loaded_at), '%Y-%m-%d') || '/' || strftime(date_trunc('week', loaded_at) + INTERVAL 6 DAY, '%Y-%m-%d') AS "Week", 0.0 AS "Cost" FROM legacy_tasks""")
def board_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A board's export with names of its own, in the older schema."""
    import uuid

    from planloom.session import shared_dir
    from planloom.sources import trackers

    t = read(spark, sf_dir, "legacy_tasks").select(F.col("task").alias("Name"), F.col("description").alias("Desc"), F.col("status").alias("List"), F.col("assignees").alias("Members"), F.date_format("loaded_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("Due"))
    path = f"{shared_dir(spark)}/planloom/csv-{uuid.uuid4().hex[:12]}"
    t.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return trackers.read_board(spark, path).select("Project", "Task", "Description", "Assignees", "Status", "Week", "Cost")


@query("""WITH d AS (SELECT *, try_cast(regexp_extract(week, '^([0-9-]{10})', 1) AS DATE) AS day FROM legacy_tasks),
f AS (SELECT *, last_value(day IGNORE NULLS) OVER (ORDER BY row_id) AS filled FROM d)
SELECT row_id, coalesce(task, '') AS "Task", project AS "Project", status AS "Status", coalesce(CASE WHEN isnan(planned_effort) THEN NULL ELSE planned_effort END, 0.0) AS "Planned_Effort", coalesce(CASE WHEN isnan(cost) THEN NULL ELSE cost END, 0.0) AS "Cost",
strftime(date_trunc('week', coalesce(filled, DATE '2020-01-01')), '%Y-%m-%d') || '/' || strftime(date_trunc('week', coalesce(filled, DATE '2020-01-01')) + INTERVAL 6 DAY, '%Y-%m-%d') AS "Week" FROM f""")
def schema_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older table mapped by guessed columns: unreadable numbers are 0, weeks are filled forward."""
    from planloom.sources import trackers

    m = trackers.map_schema(read(spark, sf_dir, "legacy_tasks").drop("loaded_at"), today="2020-01-01")
    return m.select("row_id", F.coalesce("Task", F.lit("")).alias("Task"), "Project", "Status", "Planned_Effort", "Cost", "Week")


@query("SELECT row_id, " + ", ".join(f"{_CLEAN.format(c)} AS {c}" for c in ("effort_score", "planned_effort", "actual_cost", "opt_duration", "reach")) + ", CAST(NULL AS DOUBLE) AS cost_limit FROM external_input")
def canonical_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = canonical(read(spark, sf_dir, "external_input"))
    return t.select("row_id", "effort_score", "planned_effort", "actual_cost", "opt_duration", "reach", F.lit(None).cast("double").alias("cost_limit"))


_W = "regexp_replace(regexp_replace({0}, '[;,|/]+', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')"


@query(f"SELECT row_id, array_to_string(list_filter(string_split({_W.format(chr(99) + 'oalesce(depends_on, ' + chr(39) * 2 + ')')}, ' '), lambda x: x <> ''), '~') AS preds FROM external_input")
def dependency_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "external_input").select("row_id", F.array_join(text.dependencies(F.col("depends_on")), "~").alias("preds"))


_LISTED = """SELECT row_id, CASE WHEN s[1] = '[' THEN CASE WHEN json_valid(s) THEN from_json(s, '["VARCHAR"]') ELSE [] END
  ELSE list_filter(list_transform(regexp_split_to_array(""" + _TIDY.format("s") + """, '[+;,/|&]+'), lambda x: trim(x)), lambda x: x <> '') END AS l FROM (SELECT row_id, trim(coalesce({0}, '')) AS s FROM {1})"""


@query(f"SELECT row_id, array_to_string(l, '~') AS items, coalesce(l[1], '') AS lead FROM ({_LISTED.format('assignees_list', 'external_input')})")
def list_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "external_input")
    return t.select("row_id", F.array_join(text.list_of(F.col("assignees_list")), "~").alias("items"), text.first_of(F.col("assignees_list")).alias("lead"))


@query("SELECT row_id, array_to_string(list_filter(list_transform(regexp_split_to_array(" + _TIDY.format("assignees") + ", '[;,/|]'), lambda x: trim(x)), lambda x: x <> ''), '~') AS people FROM legacy_tasks")
def legacy_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "legacy_tasks").select("row_id", F.array_join(text.split_people(F.col("assignees"), r"[;,/|]"), "~").alias("people"))


@query("SELECT row_id, strftime(date_trunc('week', loaded_at), '%Y-%m-%d') || '/' || strftime(date_trunc('week', loaded_at) + INTERVAL 6 DAY, '%Y-%m-%d') AS period, CASE WHEN isnan(n) THEN NULL ELSE n END AS number FROM (SELECT *, try_cast(replace(week, ',', '.') AS DOUBLE) AS n FROM legacy_tasks)")
def week_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planloom.sources import trackers

    return read(spark, sf_dir, "legacy_tasks").select("row_id", trackers.week_text(F.col("loaded_at")).alias("period"), text.to_number(F.col("week")).alias("number"))


@query(r"""SELECT DISTINCT name, lower(regexp_replace(regexp_replace(strip_accents(trim(name)), '[^\x00-\x7F]', '', 'g'), '\s+', ' ', 'g')) AS plain,
regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(strip_accents(trim(replace(replace(name, 'đ', 'd'), 'Đ', 'D'))), '[^\x00-\x7F]', '', 'g'), '\s+', ' ', 'g')), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g') AS bare
FROM (SELECT assigned_member AS name FROM external_input UNION SELECT task_leader FROM external_input) WHERE name IS NOT NULL""")
def name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as they are compared: decomposed without other letters, and bare."""
    t = read(spark, sf_dir, "external_input")
    names = t.select(F.explode(F.array("assigned_member", "task_leader")).alias("name")).where(F.col("name").isNotNull()).distinct()
    return similarity.with_forms(names, "name")


@query("""WITH d AS (SELECT row_id, CASE WHEN isnan(effort_score) THEN NULL ELSE effort_score END AS e, CASE WHEN isnan(opt_duration) THEN NULL ELSE opt_duration END AS o, CASE WHEN isnan(most_duration) THEN NULL ELSE most_duration END AS m, CASE WHEN isnan(pess_duration) THEN NULL ELSE pess_duration END AS p FROM external_input)
SELECT row_id, CASE WHEN o + m + p IS NULL THEN coalesce(e, 1) * 0.8 ELSE o END AS opt, CASE WHEN o + m + p IS NULL THEN coalesce(e, 1) ELSE m END AS most, CASE WHEN o + m + p IS NULL THEN coalesce(e, 1) * 1.25 ELSE p END AS pess FROM d""")
def duration_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "external_input").select("row_id", *schedule.durations("effort_score", "opt_duration", "most_duration", "pess_duration"))


@query("WITH RECURSIVE " + _CLUSTERS + " SELECT p_partkey, canonical AS member FROM part JOIN g ON p_name = name JOIN c USING (seed)")
def merged_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names replaced by their group's canonical one."""
    from planloom.plans import ingest

    t = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("member"))
    return ingest.merge_members(t, ["member"], []).withColumnRenamed("row_id", "p_partkey")


_IN_TASKS = """WITH t AS (SELECT row_id, """ + _TIDY.format("task") + """ AS task, coalesce(project, '') AS project, list_filter(list_transform(regexp_split_to_array(""" + _TIDY.format("assignees") + """, '[+;,/|&]+'), lambda x: trim(x)), lambda x: x <> '') AS team,
  lower(""" + _TIDY.format("status") + """) AS s, CASE WHEN isnan(planned_effort) THEN NULL ELSE planned_effort END AS planned, CASE WHEN isnan(cost) THEN NULL ELSE cost END AS cost FROM legacy_tasks),
k AS (SELECT *, """ + f"CASE WHEN s IN {_in(text.NOT_STARTED_WORDS)} THEN 'Not Started' WHEN {_like('s', text.PROGRESS_PARTS)} THEN 'In Progress' WHEN {_like('s', text.DONE_PARTS)} THEN 'Completed' ELSE 'In Progress' END" + """ AS state FROM t
  WHERE length(task) >= 2 AND regexp_matches(task, '[A-Za-zÀ-ỹ]') AND lower(task) NOT IN ('mon', 'tue', 'wed', 'thu', 'fri', 'sat', 'sun', 'monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday', 'sunday') AND len(team) > 0),
f AS (SELECT bool_or(state = 'In Progress') OR count(DISTINCT state) >= 3 AS keep FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY project, task, team[1] ORDER BY row_id) AS r FROM k)
SELECT row_id, project, task, team[1] AS task_leader, CASE WHEN keep OR state = 'Completed' THEN state ELSE 'Not Started' END AS completion_status, planned AS planned_effort, round(cost, 2) AS actual_cost FROM r CROSS JOIN f WHERE r.r = 1 AND planned IS NOT NULL AND cost IS NOT NULL"""


@query(_IN_TASKS)
def ingest_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older table through the ingest of raw sheets: task texts, leads, states, first of equals; rows whose amounts were given."""
    from planloom.plans import ingest

    raw = read(spark, sf_dir, "legacy_tasks").select("row_id", "task", "project", "assignees", "status", F.col("planned_effort").cast("string").alias("planned effort"), F.col("cost").cast("string").alias("actual cost"))
    given = raw.where(F.nanvl(F.col("planned effort").cast("double"), F.lit(None)).isNotNull() & F.nanvl(F.col("actual cost").cast("double"), F.lit(None)).isNotNull()).select("row_id")
    t = ingest.build_tasks(raw, merge=False)
    return t.join(given, "row_id", "left_semi").select("row_id", "project", "task", "task_leader", "completion_status", "planned_effort", "actual_cost")


@query()
def entity_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignees by their canonical spelling, sequence-matched in row order."""
    linked = similarity.link_entities(read(spark, sf_dir, "legacy_tasks").select("row_id", "assignees"), "assignees", "row_id")
    return linked.select("row_id", F.array_join("assignees_list", "~").alias("people"), "assigned_member")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, CAST(sum(CAST(coalesce(value, 0) AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planloom.streaming import events

    path = f"{sf_dir}/events.parquet"
    table = spark.read.parquet(path)
    alone = table.inputFiles()[0].endswith("/events.parquet")  # streams read folders
    source = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet" if alone else "*.parquet")
    return events.run_to_table(events.daily(source.parquet(sf_dir if alone else path)), spark, ["day", "event_type"])
