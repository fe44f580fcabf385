"""Schemas that drift between files: a lifespan catalogue of names, types and fields.

1. Every readable line (a JSON object) is exploded into its fields inside the JVM, and each file gets
   a footer: for each name the number of lines and of values of each JSON type.
2. Names are resolved to the fields of a catalogue through an alias table. A name the table lacks is
   resolved by evidence: the field whose values stood under the same card in other files of the
   tracker, if they agree for at least half of the name's cells.
3. Over the files of a tracker in order, each field's (name, type) form islands of consecutive
   files. Where an island begins or ends the change is logged: added, removed, renamed, retyped.
4. The same table of names gives the casts by which all lines come out as one table.

Scale: lines meet one aggregation with map-side combining, keyed by file and name; everything after
works on footers (files x fields), which are far fewer than lines. Windows run per tracker and field
over footers.

Defined results
- unreadable, blank and null lines, and JSON that is no object: not read and not counted anywhere.
- names that resolve to no field, and readable lines with only such names: left out, without a report.
- a file without readable lines has no fields. A tracker's first file has no changes.
- two names for one field in a file: the one in more lines, then the smaller name.
- a type is that of most non-null values (ties: the first of array, number, object, string); a file
  whose values are all null keeps the last known type.
- lines of unknown files take no part in changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planloom.session import cut

# Other names of the catalogue's fields, in the languages of the trackers; compared
# after dropping case, blanks and signs.
FIELD_ALIASES: dict[str, tuple[str, ...]] = {
    "card_no": ("card", "card number", "kartennummer", "numéro de carte", "número de tarjeta", "số thẻ"),
    "task": (
        "activity", "aufgabe", "công việc", "summary", "task name", "task title", "title", "tsk_txt", "tâche", "tarea", "what", "work_item", "work item", "titel", "titre", "título", "vorgang",
    ),
    "assigned_member": ("assignee", "member", "assigned to", "zuständig", "responsable", "người thực hiện", "bearbeiter"),
    "task_leader": ("leader", "lead", "task lead", "owner", "leitung", "người phụ trách"),
    "planned_effort": (
        "aufwand geplant", "budget_h", "charge prévue", "công dự kiến", "effort plan", "est_hours", "estimate", "estimated hours", "hrs_planned", "plan (h)", "planned hours", "plannedeff",
        "esfuerzo previsto", "plan hours", "geplanter aufwand", "effort planned",
    ),
    "actual_cost": (
        "ac", "actcost", "chi thực tế", "cost (act.)", "cost_to_date", "dépensé", "ist-kosten", "money_out", "real cost", "spent", "cost actual", "coste real", "costo real", "gasto", "coût réel",
    ),
    "week": ("wk", "woche", "semaine", "semana", "tuần", "kw"),
    "completion_status": ("stage", "state", "trạng thái", "status", "zustand", "statut", "état", "estado"),
    "depends_on": ("predecessor", "predecessors", "vorgänger", "prédécesseur", "predecesor", "phụ thuộc"),
    "business_value": ("value", "bv", "geschäftswert"),
    "risk_reduction": ("rr", "risikominderung"),
    "job_size": ("size", "größe", "taille", "tamaño"),
    "reach": ("reichweite", "portée", "alcance"),
    "impact": ("wirkung", "impacto"),
    "confidence": ("konfidenz", "confiance", "confianza"),
    "skills": ("skill", "fähigkeiten", "compétences", "habilidades", "kỹ năng"),
}
TYPES = ("array", "number", "object", "string")


def plain_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def alias_frame(fields: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """(plain, alias_field): each field's own name and its aliases; a field's own name wins."""
    spark = fields.sparkSession
    rows = [(f, a) for f, names in aliases.items() for a in names]
    listed = spark.createDataFrame(rows or [("", "")], "alias_field string, alias string").select(plain_name(F.col("alias")).alias("plain"), "alias_field", F.lit(1).alias("rank"))
    own = fields.select(plain_name(F.col("field_name")).alias("plain"), F.col("field_name").alias("alias_field"), F.lit(0).alias("rank"))
    known = listed.join(fields.select(F.col("field_name").alias("alias_field")), "alias_field", "left_semi").select("plain", "alias_field", "rank")
    return own.unionByName(known).where(F.length("plain") > 0).groupBy("plain").agg(F.min_by("alias_field", F.struct("rank", "alias_field")).alias("alias_field"))


def cells(lines: DataFrame) -> DataFrame:
    """One row (file_id, line_no, name, v, kind) per field of a readable line; v is the value as a variant."""
    spark = lines.sparkSession
    parsed = lines.select("file_id", "line_no", F.try_parse_json("payload").alias("doc")).where(F.col("doc").isNotNull())
    parsed = parsed.where(F.schema_of_variant("doc").startswith("OBJECT"))
    ex = parsed.lateralJoin(spark.tvf.variant_explode(F.col("doc").outer()))
    form = F.schema_of_variant("value")
    kind = (
        F.when(form.startswith("ARRAY"), "array").when(form.startswith("OBJECT"), "object").when(form == "STRING", "string")
        .when(form == "VOID", None).when(form == "BOOLEAN", "boolean").otherwise("number")
    )
    return ex.where(F.col("key").isNotNull()).select("file_id", "line_no", F.col("key").alias("name"), F.col("value").alias("v"), kind.alias("kind"))


def text_of(v: Column) -> Column:
    """A value as text: of an object its amount, value, title or name, of an array its first element."""
    inner = F.coalesce(*[F.try_variant_get(v, p, "string") for p in ("$.amount", "$.value", "$.hours", "$.title", "$.name", "$.text", "$[0]")])
    return F.coalesce(inner, F.try_variant_get(v, "$", "string"))


def number_of(t: Column) -> Column:
    """The number in a text such as 'EUR 1 074,15', '138.32€', '1.234.567' or '2.5e3 h'.

    Of points and commas the last kind is the decimal sign, unless it occurs more than once: then,
    and with the other kind, it groups digits. A single one is always the decimal sign."""
    s = F.regexp_extract(F.regexp_replace(t, r"(?<=\d)[\s\u00a0\u202f'’](?=\d{3}(?!\d))", ""), r"[-+]?\d+(?:[.,]\d+)*(?:[eE][-+]?\d+)?", 0)
    # goes: a sign with another one behind it, and one with its like before it (doubles end long before 400 digits)
    plain = F.regexp_replace(s, r"[.,](?=.*[.,])|(?<=\.[\d,]{0,400})\.|(?<=,[\d.]{0,400}),", "")
    return F.replace(plain, F.lit(","), F.lit(".")).try_cast("double")


def amount_of(v: Column, kind: Column) -> Column:
    """The number a value stands for: a JSON number as it is, anything else through its text."""
    return F.when(kind == "number", F.try_variant_get(v, "$", "double")).otherwise(number_of(text_of(v)))


def footers(lines: DataFrame) -> DataFrame:
    """(file_id, name, n_lines, n_array, n_number, n_object, n_string): what the lines of each file hold."""
    counts = [F.count_if(F.col("kind") == t).alias(f"n_{t}") for t in TYPES]
    return cells(lines).groupBy("file_id", "name").agg(F.count(F.lit(1)).alias("n_lines"), *counts)


def _evidence(lines: DataFrame, files: DataFrame, foot: DataFrame, named: DataFrame) -> DataFrame:
    """(name, field) for names without alias, from values that other files of the tracker hold for the same card."""
    # only trackers in which such a name stands are read again
    placed = files.select("file_id", "tracker_id")
    odd = foot.join(named.where(F.col("alias_field").isNull()), "name").select("file_id").distinct().join(placed, "file_id").select("tracker_id").distinct()
    placed = cut(placed.join(odd, "tracker_id", "left_semi"), "placed")
    c = cells(lines.join(placed.select("file_id"), "file_id", "left_semi")).join(placed, "file_id").join(named, "name")
    t = F.lower(F.trim(text_of(F.col("v"))))
    c = c.select("tracker_id", "file_id", "line_no", "name", "alias_field", t.alias("t"))
    c = cut(c.withColumn("t", F.coalesce(number_of(F.col("t")).cast("string"), "t")), "cells")
    card = c.where(F.col("alias_field") == "card_no").select("file_id", "line_no", F.col("t").alias("card")).distinct()
    c = c.where(F.col("t").isNotNull()).join(card, ["file_id", "line_no"])
    unknown = c.where(F.col("alias_field").isNull()).select("tracker_id", "card", "t", "name").groupBy("tracker_id", "card", "t", "name").agg(F.count(F.lit(1)).alias("n"))
    known = c.where(F.col("alias_field").isNotNull() & (F.col("alias_field") != "card_no")).select("tracker_id", "card", "t", F.col("alias_field").alias("field")).distinct()
    votes = unknown.join(known, ["tracker_id", "card", "t"]).groupBy("name", "field").agg(F.sum("n").alias("votes"))
    total = unknown.groupBy("name").agg(F.sum("n").alias("total"))
    best = votes.groupBy("name").agg(F.max_by(F.struct("field", "votes"), F.struct("votes", "field")).alias("b"))
    return best.join(total, "name").where(F.col("b.votes") * 2 >= F.col("total")).select("name", F.col("b.field").alias("field"))


def resolved_footers(lines: DataFrame, files: DataFrame, fields: DataFrame, aliases: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Footers with tracker_id, the file's place seq in its tracker, and field (null: no field of the catalogue)."""
    order = W.partitionBy("tracker_id").orderBy("exported_at", "file_id")
    placed = files.select("file_id", "tracker_id", F.row_number().over(order).alias("seq"))
    foot = cut(footers(lines), "footers")
    named = foot.select("name").distinct().withColumn("plain", plain_name(F.col("name")))
    named = named.join(alias_frame(fields, FIELD_ALIASES if aliases is None else aliases), "plain", "left").select("name", "alias_field")
    named = cut(named, "names")
    if named.where(F.col("alias_field").isNull()).isEmpty():
        mapped = named.select("name", F.col("alias_field").alias("field"))
    else:
        found = _evidence(lines, files, foot, named)
        mapped = named.join(found, "name", "left").select("name", F.coalesce("alias_field", "field").alias("field"))
    return foot.join(placed, "file_id").join(mapped, "name", "left")


def presence(foot: DataFrame) -> DataFrame:
    """(tracker_id, seq, file_id, field, name, kind): one row per field present in a file."""
    most = F.greatest(*[F.col(f"n_{t}") for t in TYPES])
    kind = F.coalesce(*[F.when((F.col(f"n_{t}") == most) & (most > 0), t) for t in TYPES])
    return (
        foot.where(F.col("field").isNotNull()).groupBy("tracker_id", "seq", "file_id", "field")
        .agg(F.min_by(F.struct("name", kind.alias("kind")), F.struct((-F.col("n_lines")).alias("n"), "name")).alias("b"))
        .select("tracker_id", "seq", "file_id", "field", F.col("b.name").alias("name"), F.col("b.kind").alias("kind"))
    )


def _with_neighbours(present: DataFrame) -> DataFrame:
    w = W.partitionBy("tracker_id", "field").orderBy("seq")
    known = F.last("kind", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    p = present.withColumn("kind", known)
    return p.withColumns({"before": F.lag("seq").over(w), "after": F.lead("seq").over(w), "name_before": F.lag("name").over(w), "kind_before": F.lag("kind").over(w)})


def changes(present: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, field_name, change): the starts and ends of the islands."""
    order = W.partitionBy("tracker_id").orderBy("exported_at", "file_id")
    placed = files.select("file_id", "tracker_id", F.row_number().over(order).alias("seq"))
    p = _with_neighbours(present)
    runs_on = F.coalesce(F.col("before") == F.col("seq") - 1, F.lit(False))
    logged = F.array_compact(F.array(
        F.when(~runs_on & (F.col("seq") > 1), F.struct(F.col("seq").alias("at"), F.lit("added").alias("change"))),
        F.when(F.coalesce(F.col("after") != F.col("seq") + 1, F.lit(True)), F.struct((F.col("seq") + 1).alias("at"), F.lit("removed").alias("change"))),
        F.when(runs_on & (F.col("name") != F.col("name_before")), F.struct(F.col("seq").alias("at"), F.lit("renamed").alias("change"))),
        F.when(runs_on & (F.col("kind") != F.col("kind_before")), F.struct(F.col("seq").alias("at"), F.lit("retyped").alias("change"))),
    ))
    log = p.select("tracker_id", "field", F.explode(logged).alias("c")).select("tracker_id", "field", F.col("c.at").alias("seq"), "c.change")
    # A field that ends with the tracker's last file has no next file, so the join drops it.
    return log.join(placed, ["tracker_id", "seq"]).select("file_id", F.col("field").alias("field_name"), "change")


def lifespans(present: DataFrame) -> DataFrame:
    """The catalogue: (tracker_id, field, name, kind, first_file, last_file, n_files) of each island."""
    p = _with_neighbours(present)
    starts = F.coalesce((F.col("before") != F.col("seq") - 1) | (F.col("name") != F.col("name_before")) | ~F.col("kind").eqNullSafe(F.col("kind_before")), F.lit(True))
    w = W.partitionBy("tracker_id", "field").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        p.withColumn("island", F.sum(starts.cast("int")).over(w)).groupBy("tracker_id", "field", "name", "kind", "island")
        .agg(F.min_by("file_id", "seq").alias("first_file"), F.max_by("file_id", "seq").alias("last_file"), F.count(F.lit(1)).alias("n_files")).drop("island")
    )


def one_table(lines: DataFrame, foot: DataFrame, fields: DataFrame, max_fields: int = 2000) -> DataFrame:
    """All readable lines as one table: file_id, line_no and each catalogue field, cast to its kind.

    Numbers come out as doubles, strings as text, arrays as JSON text."""
    listed = fields.select("field_name", "value_kind").distinct().orderBy("field_name").limit(max_fields + 1).collect()
    if len(listed) > max_fields:
        raise ValueError(f"more than {max_fields} fields")
    kinds = {r.field_name: r.value_kind for r in listed}
    chosen = foot.where(F.col("field").isNotNull()).select("file_id", "name", "field")
    c = cells(lines).join(chosen, ["file_id", "name"]).withColumns({"t": text_of(F.col("v")), "j": F.to_json("v")})
    out = []
    for f, kind in kinds.items():
        value = amount_of(F.col("v"), F.col("kind")) if kind == "number" else F.col("j") if kind == "array" else F.col("t")
        out.append(F.max(F.when((F.col("field") == f) & F.col("kind").isNotNull(), value)).alias(f))
    return c.groupBy("file_id", "line_no").agg(*out)
