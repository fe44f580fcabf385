"""The queries of the general data problems, over the whole tables of a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.operators import drift, hierarchy, impute, packed
from planloom.session import read


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for table, column in (("external_input", "assignees_list"), ("legacy_tasks", "assignees")):
        parts.append(packed.explode_packed(read(spark, sf_dir, table), column, ["row_id"]).select(F.lit(table).alias("src"), "row_id", "pos", "item"))
    return parts[0].unionByName(parts[1])


def _footers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    lines, files, fields = (read(spark, sf_dir, t) for t in ("staged_lines", "staged_files", "field_catalog"))
    return drift.resolved_footers(lines, files, fields), lines, files, fields


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    foot, _, files, _ = _footers(spark, sf_dir)
    return drift.changes(drift.presence(foot), files)


def p2_lifespans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.lifespans(drift.presence(_footers(spark, sf_dir)[0]))


def p2_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    foot, lines, _, fields = _footers(spark, sf_dir)
    return drift.one_table(lines, foot, fields)


def p2_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_table with the number of skills instead of their JSON text, which engines write differently."""
    t = p2_table(spark, sf_dir)
    return t.withColumn("n_skills", F.json_array_length("skills").cast("long")).drop("skills")


AMOUNTS = ["planned_effort", "actual_cost", "effort_score"]


def p4_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every missing amount with its fill, the level it was filled at and the donors."""
    return impute.hot_deck(read(spark, sf_dir, "external_input"), "row_id", AMOUNTS, "task", "project", "completion_status", "week").drop("filled_label")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_filled(spark, sf_dir).select("row_id", "field_name")


def p4_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "external_input")
    return impute.filled_table(df, p4_filled(spark, sf_dir), "row_id", AMOUNTS)


def p4_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the filled table: which amounts were filled, and the others as they were."""
    t = p4_table(spark, sf_dir)
    return t.select("row_id", *[x for c in AMOUNTS for x in (F.when(~F.col(f"{c}_filled"), F.col(c)).alias(c), f"{c}_filled")])


def p4_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every missing status or leader with the weighted majority of its closest records."""
    fills = impute.hot_deck(read(spark, sf_dir, "external_input"), "row_id", AMOUNTS, "task", "project", "completion_status", "week", labels=["completion_status", "task_leader"], fill=["completion_status", "task_leader"])
    return fills.select("row_id", "field_name", "filled_label", "level", "n_donors", "donors")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = hierarchy.hierarchy(read(spark, sf_dir, "external_input"), "task", "depends_on", "row_id", paths=False)
    return tree.select(F.col("name").alias("task"), F.col("root").alias("root_task"), "depth")


def p5_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every task with its path, depth, root and how many descendants it has."""
    tree = hierarchy.hierarchy(read(spark, sf_dir, "external_input"), "task", "depends_on", "row_id")
    return tree.select(F.col("name").alias("task"), F.col("root").alias("root_task"), "depth", F.array_join("path", " > ").alias("path"), "n_descendants")


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a task and one of its descendants, with their distance."""
    tree = hierarchy.hierarchy(read(spark, sf_dir, "external_input"), "task", "depends_on", "row_id", paths=False)
    return hierarchy.descendants(tree).withColumnRenamed("name", "task")


QUERIES = {
    "p1_found": p1_found, "p2_found": p2_found, "p2_lifespans": p2_lifespans, "p2_table": p2_table, "p2_numbers": p2_numbers, "p4_found": p4_found, "p4_filled": p4_filled, "p4_labels": p4_labels, "p4_table": p4_table, "p4_kept": p4_kept,
    "p5_found": p5_found, "p5_tree": p5_tree, "p5_descendants": p5_descendants,
}


# What the fields are called in the staged files, written out for the SQL.
_NAMES = {
    "card_no": "card_no | card | card number | kartennummer | numéro de carte | número de tarjeta | số thẻ",
    "task": "task | activity | aufgabe | công việc | summary | task name | task title | title | tsk_txt | tâche | tarea | what | work_item | work item | titel | titre | título | vorgang",
    "assigned_member": "assigned_member | assignee | member | assigned to | zuständig | responsable | người thực hiện | bearbeiter",
    "task_leader": "task_leader | leader | lead | task lead | owner | leitung | người phụ trách",
    "planned_effort": "planned_effort | aufwand geplant | budget_h | charge prévue | công dự kiến | effort plan | est_hours | estimate | estimated hours | hrs_planned | plan (h) | planned hours | plannedeff | esfuerzo previsto | plan hours | geplanter aufwand | effort planned",
    "actual_cost": "actual_cost | ac | actcost | chi thực tế | cost (act.) | cost_to_date | dépensé | ist-kosten | money_out | real cost | spent | cost actual | coste real | costo real | gasto | coût réel",
    "week": "week | wk | woche | semaine | semana | tuần | kw",
    "completion_status": "completion_status | stage | state | trạng thái | status | zustand | statut | état | estado",
    "depends_on": "depends_on | predecessor | predecessors | vorgänger | prédécesseur | predecesor | phụ thuộc",
    "business_value": "business_value | value | bv | geschäftswert",
    "risk_reduction": "risk_reduction | rr | risikominderung",
    "job_size": "job_size | size | größe | taille | tamaño",
    "reach": "reach | reichweite | portée | alcance",
    "impact": "impact | wirkung | impacto",
    "confidence": "confidence | konfidenz | confiance | confianza",
    "skills": "skills | skill | fähigkeiten | compétences | habilidades | kỹ năng",
}
_VALUES = ", ".join("('{}', '{}')".format(n.replace("'", "''"), f) for f, names in _NAMES.items() for n in names.split(" | "))
_PLAIN = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_P2_FILES = f"""WITH al AS (SELECT {_PLAIN.format('a')} AS plain, f FROM (VALUES {_VALUES}) v(a, f)),
c AS (SELECT file_id, line_no, j.key AS name, CASE j.type WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN NULL WHEN 'BOOLEAN' THEN NULL ELSE 'number' END AS kind
  FROM (SELECT * FROM staged_lines WHERE json_valid(payload)) l, json_each(l.payload) j WHERE json_type(l.payload) = 'OBJECT'),
n AS (SELECT file_id, f AS field, name, count(*) AS k, count(*) FILTER (kind = 'array') AS a, count(*) FILTER (kind = 'number') AS u, count(*) FILTER (kind = 'object') AS o, count(*) FILTER (kind = 'string') AS s
  FROM c JOIN al ON al.plain = {_PLAIN.format('c.name')} GROUP BY ALL),
b AS (SELECT file_id, field, name, CASE greatest(a, u, o, s) WHEN 0 THEN NULL WHEN a THEN 'array' WHEN u THEN 'number' WHEN o THEN 'object' ELSE 'string' END AS kind FROM n
  QUALIFY row_number() OVER (PARTITION BY file_id, field ORDER BY k DESC, name) = 1),
f AS (SELECT file_id, tracker_id, row_number() OVER (PARTITION BY tracker_id ORDER BY exported_at, file_id) AS seq FROM staged_files)"""
_P2 = _P2_FILES + """,
g AS (SELECT f.tracker_id, f.seq, f.file_id, x.field, b.name, last_value(b.kind IGNORE NULLS) OVER (PARTITION BY f.tracker_id, x.field ORDER BY f.seq) AS kind
  FROM f CROSS JOIN (SELECT DISTINCT field FROM b) x LEFT JOIN b ON b.file_id = f.file_id AND b.field = x.field),
w AS (SELECT *, lag(name) OVER o AS name0, lag(kind) OVER o AS kind0 FROM g WINDOW o AS (PARTITION BY tracker_id, field ORDER BY seq))
SELECT file_id, field AS field_name, unnest(list_filter([CASE WHEN name0 IS NULL AND name IS NOT NULL THEN 'added' END, CASE WHEN name0 IS NOT NULL AND name IS NULL THEN 'removed' END,
  CASE WHEN name <> name0 THEN 'renamed' END, CASE WHEN name IS NOT NULL AND name0 IS NOT NULL AND kind <> kind0 THEN 'retyped' END], lambda x: x IS NOT NULL)) AS change FROM w WHERE seq > 1"""

_LIVES = _P2_FILES + """, p AS (SELECT f.tracker_id, f.seq, f.file_id, b.field, b.name, last_value(b.kind IGNORE NULLS) OVER (PARTITION BY f.tracker_id, b.field ORDER BY f.seq) AS kind FROM f JOIN b ON b.file_id = f.file_id),
s AS (SELECT *, CASE WHEN lag(seq) OVER o = seq - 1 AND lag(name) OVER o = name AND lag(kind) OVER o IS NOT DISTINCT FROM kind THEN 0 ELSE 1 END AS starts FROM p WINDOW o AS (PARTITION BY tracker_id, field ORDER BY seq)),
i AS (SELECT *, sum(starts) OVER (PARTITION BY tracker_id, field ORDER BY seq) AS island FROM s)
SELECT tracker_id, field, name, kind, arg_min(file_id, seq) AS first_file, arg_max(file_id, seq) AS last_file, count(*) AS n_files FROM i GROUP BY tracker_id, field, name, kind, island"""

_WORDS = "coalesce(v ->> '$.amount', v ->> '$.value', v ->> '$.hours', v ->> '$.title', v ->> '$.name', v ->> '$.text', v ->> '$[0]', v ->> '$')"
_DIGITS = "regexp_extract(regexp_replace(t, '(\\d)[\\s\u00a0\u202f](\\d\\d\\d)', '\\1\\2', 'g'), '[-+]?\\d+(?:[.,]\\d+)*(?:[eE][-+]?\\d+)?')"
_NUMBER = "TRY_CAST(CASE WHEN contains(d, ',') AND contains(d, '.') AND strpos(reverse(d), ',') > strpos(reverse(d), '.') THEN replace(d, ',', '') WHEN contains(d, ',') AND contains(d, '.') THEN replace(replace(d, '.', ''), ',', '.') ELSE replace(d, ',', '.') END AS DOUBLE)"
_NUMERIC = ("actual_cost", "business_value", "card_no", "confidence", "impact", "job_size", "planned_effort", "reach", "risk_reduction", "week")
_TEXTS = ("assigned_member", "completion_status", "depends_on", "task", "task_leader")
_TABLE = _P2_FILES + f""", e AS (SELECT l.file_id, l.line_no, b.field, j.value AS v, j.type AS ty FROM (SELECT * FROM staged_lines WHERE json_valid(payload) AND json_type(payload) = 'OBJECT') l, json_each(l.payload) j
  JOIN n ON n.file_id = l.file_id AND n.name = j.key JOIN b ON b.file_id = n.file_id AND b.field = n.field AND (n.name = b.name OR true) WHERE b.file_id = l.file_id),
t AS (SELECT file_id, line_no, field, v, ty, {_WORDS} AS t FROM e), d AS (SELECT *, {_DIGITS} AS d FROM t),
x AS (SELECT *, CASE WHEN ty IN ('DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT') THEN CAST(v ->> '$' AS DOUBLE) ELSE {_NUMBER} END AS num FROM d)
SELECT file_id, line_no, {", ".join(f"max(num) FILTER (field = '{f}' AND ty <> 'NULL') AS {f}" for f in _NUMERIC)}, {", ".join(f"max(t) FILTER (field = '{f}' AND ty <> 'NULL') AS {f}" for f in _TEXTS)},
max(json_array_length(v)) FILTER (field = 'skills' AND ty = 'ARRAY') AS n_skills FROM x GROUP BY file_id, line_no"""

# The values in these tables that stand for 'missing', as one sees them there.
_MISSING = """m AS (SELECT row_id, field_name, bool_or(x IS NULL OR isnan(x) OR x < 0 OR x = 'infinity'::DOUBLE OR x IN (9999.0, 99999.0, 999999.99, 88888888.0)) AS missing, any_value(x) AS x FROM (
  SELECT row_id, 'planned_effort' AS field_name, planned_effort AS x FROM external_input UNION ALL SELECT row_id, 'actual_cost', actual_cost FROM external_input UNION ALL SELECT row_id, 'effort_score', effort_score FROM external_input) GROUP BY row_id, field_name)"""
_P4 = f"WITH {_MISSING} SELECT row_id, field_name FROM m WHERE missing"
_KEPT = f"WITH {_MISSING} SELECT row_id, " + ", ".join(f"max(CASE WHEN field_name = '{c}' AND NOT missing THEN x END) AS {c}, bool_or(field_name = '{c}' AND missing) AS {c}_filled" for c in ("planned_effort", "actual_cost", "effort_score")) + " FROM m GROUP BY row_id"

_KEY = "lower(regexp_replace({0}, '^[\\s\\p{{Z}}\"''“”„‘’`´«»\\[\\](){{}}<>,;|/\\\\.:&+*#-]+|[\\s\\p{{Z}}\"''“”„‘’`´«»\\[\\](){{}}<>,;|/\\\\.:&+*#-]+$', '', 'g'))"
_TREE = f"""WITH RECURSIVE n AS (SELECT task, arg_min(ref, row_id) FILTER (ref IS NOT NULL) AS ref FROM (SELECT task, row_id, nullif({_KEY.format('depends_on')}, '') AS ref FROM external_input WHERE trim(task) <> '') GROUP BY task),
k AS (SELECT {_KEY.format('task')} AS key, min(task) AS parent FROM n GROUP BY 1), e AS (SELECT task, parent FROM n LEFT JOIN k ON ref = key), z AS (SELECT count(*) AS z FROM e),
w AS (SELECT task, task AS at_task, 0 AS d FROM e UNION ALL SELECT w.task, e.parent, d + 1 FROM w JOIN e ON e.task = w.at_task CROSS JOIN z WHERE e.parent IS NOT NULL AND d < 2 * z),
r AS (SELECT task, CASE WHEN max(d) < any_value(2 * z) THEN arg_max(at_task, d) ELSE min(at_task) FILTER (d >= z) END AS root_task, CASE WHEN max(d) < any_value(2 * z) THEN max(d) ELSE -1 END AS depth FROM w CROSS JOIN z GROUP BY task),
u AS (SELECT w.task AS descendant, w.at_task AS task, w.d AS distance FROM w JOIN r ON r.task = w.task WHERE r.depth >= 0)"""
_P5 = _TREE + " SELECT task, root_task, depth FROM r"
_P5_TREE = _TREE + """ SELECT task, root_task, depth, p.path, n_descendants FROM r LEFT JOIN (SELECT descendant AS task, string_agg(task, ' > ' ORDER BY distance DESC) AS path FROM u GROUP BY 1) p USING (task)
LEFT JOIN (SELECT task, count(*) - 1 AS n_descendants FROM u GROUP BY 1) c USING (task)"""
_P5_DOWN = _TREE + " SELECT task, descendant, distance FROM u WHERE distance > 0"

ORACLES: dict[str, str] = {
    "p2_found": _P2, "p2_lifespans": _LIVES, "p2_numbers": _TABLE, "p4_found": _P4, "p4_kept": _KEPT, "p5_found": _P5, "p5_tree": _P5_TREE, "p5_descendants": _P5_DOWN,
}
