"""Filling missing values from similar records: nearest-neighbour hot deck in hash blocks.

1. `missing_cells`: a numeric cell is missing when it is null, not a number, infinite, negative, or a
   stand-in. Zero is an amount, and so are most large ones. A value over 20 times the column's median
   is a stand-in when it is written with one digit only, four times or more (9999, 999999.99, 88888888),
   and occurs twice or is over 500 times the median; any other value when it is over 100 times the
   median and occurs 20 times. No count depends on the number of rows, so a value is judged alike in
   a small and a large table; the price is that a real round amount so large and so common is taken for one.
2. Candidates come from hash blocks on observed features, each in an order: rows of the same record by
   time; rows of the same group and category by time; rows of the group by each measure that both have
   (on a log scale). Gaps that find none there look among rows of the group by time, and where the
   group has none, among all rows by their first measure and by time. Within a block donors are numbered in order, and a gap's
   `k` donors before and `k` after it are found by an equi-join on block and number: no pairs are
   formed, however large the block.
3. The candidates are ranked by their distance over all mixed features the gap has: record, group,
   category (0 or 1), time and measures (by how far apart, 1 at most); what a donor lacks counts 1.
4. Of the 2k closest the fill of a numeric field is the median, of a categorical field the majority,
   weighted by closeness. Each fill names its level (the block its closest donor came from) and its donors.

Scale: blocks are ordered in histogram cells; a cell over `cell_rows` rows is split at quantiles of its
values, and at equal values by hash ranges, so a block of a third of all rows is spread over tasks
while its order stays one: fills don't depend on `cell_rows`. Donors in blocks without a gap are left
out before anything is shuffled; later levels see only the gaps that are left.

Defined results
- gaps without any donor in the table: listed, not filled, level 'none'.
- rows with the same id give one row per field. Null keys, groups and times block nothing.
- ties in distance: the smaller donor id; ties in value or weight: the smaller value. Among equal places
  in an order the hash of the id decides.
- categorical cells are missing when null or blank.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planloom.session import Scratch, cut, drop_cut

_CELL = 16  # histogram cells per unit of the coordinate


def stand_ins(df: DataFrame, columns: list[str], far: float = 20.0) -> dict[str, list[float]]:
    """Positive values of each column that stand for 'missing'. Those of one digit are some hundreds at most, as doubles have few lengths."""
    real = {c: F.when(~F.isnan(c) & (F.col(c) >= 0) & (F.col(c) < float("inf")), F.col(c)) for c in columns}
    medians = df.agg(*[F.percentile_approx(real[c], 0.5).alias(c) for c in columns]).first()
    long = []
    for c in columns:
        if medians[c] is not None:
            unit = max(medians[c], 1e-9)
            digits = F.regexp_replace(F.regexp_replace(F.col("value").cast("decimal(24,4)").cast("string"), r"0*$", ""), r"\.", "")
            one_digit = digits.rlike(r"^([1-9])\1{3,}$") & ((F.col("n") >= 2) | (F.col("value") > 25 * far * unit))
            counts = df.select(real[c].alias("value")).where(F.col("value") > far * unit).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
            spike = (F.col("n") >= 20) & (F.col("value") > 5 * far * unit)
            long.append(counts.where(one_digit | spike).select(F.lit(c).alias("c"), "value"))
    found: dict[str, list[float]] = {c: [] for c in columns}
    if long:
        for r in reduce(DataFrame.unionByName, long).collect():
            found[r.c].append(r.value)
    return {c: sorted(v) for c, v in found.items()}


def observed(column: str, stand: list[float]) -> Column:
    """The cell's amount, or null where it is missing."""
    c = F.col(column).cast("double")
    good = ~F.isnan(c) & (c >= 0) & (c < float("inf"))
    if stand:
        good = good & ~c.isin(stand)
    return F.when(good, c)


def _place() -> Column:
    """The order among equal values."""
    return F.shiftrightunsigned(F.xxhash64("id"), 1)


def _spread_cells(units: DataFrame, cell_rows: int, scratch: Scratch) -> DataFrame:
    """units with `path`, the cell of each row: cells of a block follow each other in the block's order (x, h) and are of bounded size."""
    stored = scratch.cut(units.withColumn("path", F.array(F.floor(F.col("x") * _CELL).cast("int"))), "units")
    while True:
        u = stored.withColumn("h", _place())
        size = u.groupBy("block", "path").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.min("h").alias("hlo"), F.max("h").alias("hhi"))
        hot = scratch.cut(size.where((F.col("n") > cell_rows) & ((F.col("lo") < F.col("hi")) | (F.col("hlo") < F.col("hhi")))), "hot")
        most = hot.agg(F.max("n")).first()[0]
        if most is None:
            return u
        parts = min(1000, -(-most // cell_rows))
        mixed = hot.where("lo < hi").select("block", "path")
        bounds = u.join(mixed, ["block", "path"]).groupBy("block", "path").agg(F.array_distinct(F.percentile_approx("x", [i / parts for i in range(1, parts)] or [0.5], 10_000)).alias("q"))
        j = u.join(hot.select("block", "path", "hlo", "hhi").join(bounds, ["block", "path"], "left"), ["block", "path"], "left")
        by_value = 2 * F.size(F.filter("q", lambda q: q < F.col("x"))) + F.array_contains("q", F.col("x")).cast("int")
        by_hash = F.floor((F.col("h") - F.col("hlo")).cast("double") / (F.col("hhi") - F.col("hlo")).cast("double") * parts).cast("int")
        step = F.when(F.col("q").isNotNull(), by_value).when(F.col("hlo").isNotNull(), by_hash)
        stored = scratch.cut(j.withColumn("path", F.when(step.isNull(), F.col("path")).otherwise(F.array_append("path", step))).select(*stored.columns), "units")


def _numbered(units: DataFrame, cell_rows: int) -> DataFrame:
    """units (block, x, id, donor, ...) with `at`: how many donors of the block stand at or before it."""
    scratch = Scratch()
    u = _spread_cells(units, cell_rows, scratch)
    sums = u.groupBy("block", "path").agg(F.sum(F.col("donor").cast("long")).alias("n"))
    base = sums.select("block", "path", F.coalesce(F.sum("n").over(W.partitionBy("block").orderBy("path").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = W.partitionBy("block", "path").orderBy("x", "h", "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    own = u.withColumn("own", F.sum(F.col("donor").cast("long")).over(inner))
    out = cut(own.join(base, ["block", "path"]).withColumn("at", F.col("base") + F.col("own")).drop("own", "base", "path", "h"), "numbered")
    scratch.clear()
    return out


# Weights of the features in the distance, and the weeks that count as far apart.
_WEIGHTS = {"record": 8.0, "group": 2.0, "category": 1.0, "time": 1.0, "measure": 4.0}
_WEEKS = 8.0


def _distance(gap: Column, donor: Column, n_measures: int, level: Column) -> Column:
    """The weighted mean difference over the features the gap has; 0 to 1. Blocks up to level 4 lie within a group or record."""
    parts = [(_WEIGHTS["group"], gap["grouped"], F.when(level <= 4, 0.0).otherwise(1.0))]
    for name, w in (("record", _WEIGHTS["record"]), ("category", _WEIGHTS["category"])):
        parts.append((w, gap[name].isNotNull(), F.when(gap[name] == donor[name], 0.0).otherwise(1.0)))
    parts.append((_WEIGHTS["time"], gap["time"].isNotNull(), F.coalesce(F.least(F.abs(gap["time"] - donor["time"]) / _WEEKS, F.lit(1.0)), F.lit(1.0))))
    for i in range(n_measures):
        parts.append((_WEIGHTS["measure"], gap["m"][i].isNotNull(), F.coalesce(F.least(F.abs(gap["m"][i] - donor["m"][i]), F.lit(1.0)), F.lit(1.0))))
    total = reduce(lambda a, b: a + b, [F.when(has, w).otherwise(0.0) for w, has, _ in parts])
    apart = reduce(lambda a, b: a + b, [F.when(has, w * d).otherwise(0.0) for w, has, d in parts])
    return F.when(total > 0, apart / total).otherwise(1.0)


def _fills(units: DataFrame, k: int, cell_rows: int, n_measures: int) -> DataFrame:
    """(id, field, value, label, donors, n_donors, level): each gap's fill from its closest candidates."""
    n = _numbered(units, cell_rows)
    donors = n.where("donor").select("block", "at", F.col("id").alias("donor_id"), F.col("feat").alias("of"), "value", "label")
    gaps = n.where(~F.col("donor")).select("block", "id", "field", "level", "feat", F.explode(F.sequence(F.col("at") - k + 1, F.col("at") + k)).alias("at"))
    near = gaps.join(donors, ["block", "at"]).withColumn("d", F.round(_distance(F.col("feat"), F.col("of"), n_measures, F.col("level")), 9))
    # 2k candidates at most for each gap and block
    tier = F.when(F.col("level") <= 3, 0).when(F.col("level") == 4, 1).otherwise(2).alias("tier")
    each = near.groupBy("id", "field").agg(F.array_sort(F.collect_list(F.struct(tier, "d", "donor_id", "level", "value", "label"))).alias("c"))
    each = each.withColumn("c", F.filter("c", lambda x: x["tier"] == F.col("c")[0]["tier"]))
    one = F.slice(F.array_distinct(F.transform("c", lambda x: F.struct(x["d"], x["donor_id"], x["value"], x["label"]))), 1, 2 * k)
    best = each.select("id", "field", one.alias("b"), F.col("c")[0]["level"].alias("level"))
    w = best.select("id", "field", "level", "b", F.array_sort(F.transform("b", lambda x: F.struct(x["value"], x["label"], (1.0 / (0.02 + x["d"])).alias("w")))).alias("v"))
    half = F.aggregate("v", F.lit(0.0), lambda a, x: a + x["w"]) / 2
    nothing = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("value"))

    def median(a: Column, x: Column) -> Column:
        return F.struct((a["sum"] + x["w"]).alias("sum"), F.when(a["value"].isNull() & (a["sum"] + x["w"] >= F.col("half") - 1e-12), x["value"]).otherwise(a["value"]).alias("value"))

    votes = F.transform(F.array_distinct(F.transform("v", lambda x: x["label"])), lambda y: F.struct((-F.aggregate(F.filter("v", lambda x: x["label"] == y), F.lit(0.0), lambda a, x: a + x["w"])).alias("votes"), y.alias("label")))
    out = w.withColumn("half", half).select(
        "id", "field", F.aggregate("v", nothing, median)["value"].alias("value"), F.array_min(votes)["label"].alias("label"), F.transform("b", lambda x: x["donor_id"]).alias("donors"), F.size("b").alias("n_donors"), "level",
    )
    out = cut(out, "fills")
    drop_cut(n)
    return out


LEVELS = {1: "record", 2: "group and category", 3: "group", 4: "group and time", 5: "measure", 6: "time"}


def hot_deck(
    df: DataFrame, row: str, targets: list[str], key: str, group: str, category: str, time: str, k: int = 3, cell_rows: int = 50_000, labels: list[str] | None = None, fill: list[str] | None = None,
) -> DataFrame:
    """One row per missing cell of the numeric `targets` and the categorical `labels`: (row, field_name, filled_value, filled_label, level, n_donors, donors).

    With `fill` only those of the fields are filled; the others serve as features."""
    labels = labels or []
    stand = stand_ins(df, targets)
    nums, texts = [f"t{i}" for i in range(len(targets))], [f"s{i}" for i in range(len(labels))]
    fields = [t for t, c in zip(nums + texts, [*targets, *labels]) if fill is None or c in fill]
    hash_of = lambda c: F.when(c.isNotNull(), F.xxhash64(c))
    wide = cut(df.select(
        F.col(row).alias("id"), hash_of(F.col(key).cast("string")).alias("record"), hash_of(F.col(group).cast("string")).alias("group"), hash_of(F.lower(F.trim(F.col(category).cast("string")))).alias("category"),
        F.col(time).cast("double").alias("time"), *[observed(c, stand[c]).alias(t) for c, t in zip(targets, nums)], *[F.when(F.trim(c) != "", F.col(c)).alias(t) for c, t in zip(labels, texts)],
    ), "measures")
    by_time = F.coalesce(F.col("time"), F.lit(0.0)) / 4

    def feat(field: str) -> Column:
        """A record's features as seen for one field, which is no feature of itself."""
        own = labels[texts.index(field)] if field in texts else ""
        unless = lambda name, c: F.lit(None).cast("int").alias(name) if own == c else F.when(F.col(name).isNotNull(), F.hash(name)).alias(name)
        grouped = F.lit(False) if own == group else F.col("group").isNotNull()
        # compared only among a gap's few candidates, so 32 bits do
        return F.struct(unless("record", key), grouped.alias("grouped"), unless("category", category), F.col("time").cast("float").alias("time"), F.array(*[F.lit(None).cast("float") if m == field else F.log1p(m).cast("float") for m in nums]).alias("m"))

    def entry(level: int, field: str, parts: list[str], x: Column, of: str = "") -> Column:
        """A unit of one level's block, or null where a part of the block is null."""
        block = F.xxhash64(F.lit(level), F.lit(field), F.lit(of), *parts)
        value, label = (F.col(field), F.lit(None).cast("string")) if field in nums else (F.lit(None).cast("double"), F.col(field))
        made = F.struct(F.lit(level).alias("level"), F.lit(field).alias("field"), block.alias("block"), x.cast("double").alias("x"), value.alias("value"), label.alias("label"), feat(field).alias("feat"))
        own = labels[texts.index(field)] if field in texts else ""
        for p, c in (("record", key), ("group", group), ("category", category)):
            if p in parts:
                made = F.lit(None) if own == c else F.when(F.col(p).isNotNull(), made)
        return made

    def entries(field: str, second: bool, gap: bool) -> list[Column]:
        out = []
        if not second:
            out += [entry(1, field, ["record"], by_time), entry(2, field, ["group", "category"], by_time)]
        taken = F.lit(False)
        for m in nums:
            if m != field and not second:
                out.append(F.when(F.col(m).isNotNull(), entry(3, field, ["group"], F.log1p(m), m)))
            if m != field and second:
                # a gap goes by its first observed measure, a donor stands under every one
                out.append(F.when(F.col(m).isNotNull() & (~taken if gap else F.lit(True)), entry(5, field, [], F.log1p(m), m)))
                taken = taken | F.col(m).isNotNull()
        if second:
            out += [entry(4, field, ["group"], by_time), entry(6, field, [], by_time)]
        return [F.when(F.col(field).isNull() if gap else F.col(field).isNotNull(), e) for e in out]

    def exploded(d: DataFrame, second: bool, gap: bool) -> DataFrame:
        every = F.explode(F.array_compact(F.array(*[e for c in fields for e in entries(c, second, gap)])))
        return d.select("id", every.alias("u")).select("id", "u.*", F.lit(not gap).alias("donor"))

    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in fields])
    listed = F.explode(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in fields])))
    todo = cut(wide.where(missing).select("id", listed.alias("field")).distinct(), "gaps")
    out: list[DataFrame] = []
    # The second round is for the gaps the first has left.
    for second in (False, True):
        if todo.isEmpty():
            break
        gaps = cut(exploded(wide.where(missing), second, True).join(todo, ["id", "field"], "left_semi").dropDuplicates(["id", "field", "block"]), "open")
        donors = exploded(wide, second, False).join(gaps.select("block").distinct(), "block", "left_semi")
        got = _fills(gaps.unionByName(donors), k, cell_rows, len(nums))
        drop_cut(gaps)
        out.append(got)
        rest = cut(todo.join(got.select("id", "field"), ["id", "field"], "left_anti"), "gaps")
        drop_cut(todo)
        todo = rest
    drop_cut(wide)
    donors_type = "array<" + df.schema[row].dataType.simpleString() + ">"
    none = {"value": "double", "label": "string", "donors": donors_type}
    rest = todo.select("id", "field", *[F.lit(None).cast(t).alias(c) for c, t in none.items()], F.lit(0).alias("n_donors"), F.lit(0).alias("level"))
    fills = reduce(DataFrame.unionByName, [*out, rest])
    names = F.coalesce(*[F.when(F.col("field") == t, c) for c, t in zip([*targets, *labels], nums + texts)])
    level = F.coalesce(*[F.when(F.col("level") == n, name) for n, name in LEVELS.items()], F.lit("none"))
    return fills.select(F.col("id").alias(row), names.alias("field_name"), F.col("value").alias("filled_value"), F.col("label").alias("filled_label"), level.alias("level"), "n_donors", "donors")


def filled_table(df: DataFrame, fills: DataFrame, row: str, targets: list[str]) -> DataFrame:
    """df with every gap of the targets filled and a flag <target>_filled for each."""
    wide = fills.groupBy(row).agg(*[F.max(F.when(F.col("field_name") == c, F.struct(F.col("filled_value").alias("v")))).alias(f"__{c}") for c in targets])
    j = df.join(wide, row, "left")
    return j.select(
        *[F.when(F.col(f"__{c}").isNotNull(), F.col(f"__{c}.v")).otherwise(F.col(c)).alias(c) if c in targets else F.col(c) for c in df.columns],
        *[(F.col(f"__{c}").isNotNull()).alias(f"{c}_filled") for c in targets],
    )
