"""The task table: canonical columns, and a mapping of an order schema onto it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.session import read

TEXT = ("project", "task", "assigned_member", "task_leader", "assignees_list", "skills", "completion_status", "depends_on")
NUMERIC = (
    "effort_score", "planned_effort", "actual_cost", "business_value", "time_criticality", "risk_reduction", "job_size", "reach", "impact", "confidence", "effort",
    "opt_duration", "most_duration", "pess_duration",
)


def canonical(df: DataFrame) -> DataFrame:
    """df with every canonical column: absent text is '', absent numbers null; numbers that can't be read, and NaN, are null."""
    have = {c.lower(): c for c in df.columns}
    cols = {c: F.lit("") for c in TEXT if c not in have} | {c: F.lit(None).cast("double") for c in NUMERIC if c not in have}
    for c in NUMERIC:
        if c in have:
            d = F.col(have[c]).try_cast("double")
            cols[have[c]] = F.when(~F.isnan(d), d)
    return df.withColumns(cols)


COLUMNS = ("id", "project", "task", "leader", "assignees", "skills", "effort", "planned", "cost", "week", "status", "customer", "dated")


def order_tasks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One task per order: its project is the customer's segment, its team the suppliers of its lines.

    Only the asked columns (none: all of COLUMNS) are built: a table that none of them needs is not
    read. Lines are added up per order before any other join. Amounts are decimals, so sums don't
    depend on the order of rows; dimensions are joined by size: adaptive execution broadcasts them
    only where they are small.
    """
    want = set(columns or COLUMNS)
    if want - set(COLUMNS):
        raise ValueError(f"no such columns: {sorted(want - set(COLUMNS))}")
    t = read(spark, sf_dir, "orders")
    sums = {"assignees": F.array_sort(F.collect_set("s_name")), "skills": F.array_sort(F.collect_set("p_type")), "effort": F.sum("l_quantity"), "cost": F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)"))}
    sums = {c: f.alias(f"line_{c}") for c, f in sums.items() if c in want}
    if sums:
        line = read(spark, sf_dir, "lineitem")
        if "assignees" in want:
            line = line.join(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
        if "skills" in want:
            line = line.join(read(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"), "left")
        t = t.join(line.groupBy("l_orderkey").agg(*sums.values()), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    if want & {"project", "leader"}:
        t = t.join(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left")
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    made = {
        "id": lambda: F.col("o_orderkey"), "project": lambda: F.col("c_mktsegment"), "task": lambda: F.concat(F.lit("O"), F.col("o_orderkey")), "leader": lambda: F.col("c_name"),
        "assignees": lambda: F.col("line_assignees"), "skills": lambda: F.col("line_skills"), "effort": lambda: F.coalesce("line_effort", F.lit(1.0)),
        "planned": lambda: (F.col("o_totalprice").cast("decimal(18,2)") / 10000).cast("decimal(18,6)"), "cost": lambda: F.coalesce(F.col("line_cost"), F.lit(0)).cast("decimal(28,4)"),
        "week": lambda: (F.floor(days / 7) + 1).cast("int"), "status": lambda: F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "P", "In Progress").otherwise("Not Started"),
        "customer": lambda: F.col("o_custkey"), "dated": lambda: F.col("o_orderdate"),
    }
    return t.select(*[made[c]().alias(c) for c in COLUMNS if c in want])


# The same mapping for the SQL check.
TASKS_SQL = """
line AS (SELECT l_orderkey, list_sort(list_distinct(list(s_name))) AS assignees, list_sort(list_distinct(list(p_type))) AS skills,
                sum(l_quantity) AS qty, sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS cost
         FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
tasks AS (SELECT o_orderkey AS id, c_mktsegment AS project, 'O' || o_orderkey AS task, c_name AS leader, assignees, skills,
                 coalesce(qty, 1.0) AS effort, CAST(CAST(o_totalprice AS DECIMAL(18,2)) / 10000 AS DECIMAL(18,6)) AS planned,
                 CAST(coalesce(cost, 0) AS DECIMAL(28,4)) AS cost,
                 CAST(floor(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 7.0) + 1 AS INTEGER) AS week,
                 CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'P' THEN 'In Progress' ELSE 'Not Started' END AS status,
                 o_custkey AS customer, o_orderdate AS dated
          FROM orders LEFT JOIN line ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey)"""
