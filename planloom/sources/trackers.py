"""Readers of tracker exports: delimited files, board exports, worksheets, shared sheets, synthetic tasks.

Every reader gives text columns as they stand plus `row_id`, the order of the rows in the file;
casting happens in canonical(). Files are read in parallel by Spark; only single worksheets, which
are small by format (2^20 rows), are opened by one task.
"""

from __future__ import annotations

import io
import json
import re
import sys
import urllib.parse
import urllib.request
import uuid
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from planloom.functions.text import fill_forward, to_number
from planloom.operators.forecast import uniform
from planloom.session import shared_dir

# Header hints of the roles of columns, and the aliases of the older schema.
HINTS: dict[str, tuple[str, ...]] = {
    "task": ("task", "nhiệm vụ", "nhiem vu", "mô tả", "mo ta", "description", "công việc", "cong viec", "title", "issue", "work item"),
    "assignee": ("assigned", "assignee", "người đảm nhận", "nguoi dam nhan", "owner", "phụ trách", "phu trach", "nguoi lam", "assigned to", "người làm"),
    "week": ("week", "tuần", "chi tiết tuần", "chi tiet tuan", "sprint", "iteration"),
    "done": ("check", "done", "hoàn thành", "hoan thanh", "xong", "100%"),
    "status": ("status", "trạng thái", "trang thai", "giai đoạn", "giai doan", "progress", "tiến độ", "tinh trang"),
    "planned": ("planned effort", "công sức ước tính", "cong suc uoc tinh", "estimate", "ước tính", "effort", "sp", "story point", "complexity"),
    "cost": ("actual cost", "chi phí", "chi phi", "cost", "ac", "thực chi", "budget"),
    "project": ("project", "dự án", "du an"),
    "depends": ("depends", "phụ thuộc", "phu thuoc", "dependency", "precedence"),
}
REQUIRED = ("Task", "Project", "Description", "Assignees", "Status", "Week")
ALIASES: dict[str, tuple[str, ...]] = {
    "Task": ("task", "title", "name", "issue", "card", "subject"),
    "Project": ("project", "board", "repo", "space"),
    "Description": ("description", "desc", "body", "details", "content"),
    "Assignees": ("assignees", "assignee", "owner", "members", "assigned_to"),
    "Status": ("status", "state", "stage", "column", "list"),
    "Week": ("week", "date", "due", "deadline", "created", "updated"),
    "Planned_Effort": ("planned_effort", "estimate", "story_points", "sp", "planned"),
    "Actual_Effort": ("actual_effort", "actual", "time_spent", "hours"),
    "Cost": ("cost", "budget", "expense", "ac"),
}


def sheet_export_url(url: str) -> str:
    """The CSV export address of a shared sheet's view or edit address; other addresses as they are."""
    m = re.search(r"/spreadsheets/d/([\w-]+)", url)
    if not m or "/export" in url:
        return url
    gid = re.findall(r"#gid=(\d+)", url) or re.findall(r"[?&]gid=(\d+)", url) or ["0"]
    return f"https://docs.google.com/spreadsheets/d/{m.group(1)}/export?format=csv&gid={gid[-1]}"


def _shared(spark: SparkSession, path: str, suffix: str = ".csv") -> str:
    """A path all executors can read: stdin ('-') and what a web address holds is first copied to the shared folder."""
    if path != "-" and not path.startswith(("http://", "https://")):
        return path
    name = f"{shared_dir(spark)}/planloom/source-{uuid.uuid4().hex[:12]}{suffix}"
    target = spark._jvm.org.apache.hadoop.fs.Path(name)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(target)
    try:
        with sys.stdin.buffer if path == "-" else urllib.request.urlopen(path, timeout=60) as r:  # noqa: S310
            while chunk := r.read(1 << 20):
                out.write(bytearray(chunk))
    finally:
        out.close()
    fs.deleteOnExit(target)
    return name


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", multi_line: bool = True) -> DataFrame:
    """All columns as text, with row_id in file order.

    Quoted line breaks make a file one task; `multi_line=False` reads large files without them in parallel splits."""
    df = spark.read.csv(_shared(spark, sheet_export_url(path)), sep=sep, encoding=encoding, header=True, multiLine=multi_line, escape='"', ignoreLeadingWhiteSpace=False)
    bom = [c for c in df.columns if c.startswith("\ufeff")]
    for c in bom:
        df = df.withColumnRenamed(c, c.lstrip("\ufeff"))
    return df.withColumn("row_id", F.monotonically_increasing_id())


def guess_column(target: str, columns: list[str]) -> str | None:
    """The column of a role: exact name, then the first alias contained in a name."""
    for c in columns:
        if c.lower() == target.lower():
            return c
    return next((c for a in ALIASES.get(target, ()) for c in columns if a in c.lower()), None)


def role_columns(columns: list[str]) -> dict[str, str]:
    """For each role the first column that contains one of its hints."""
    found = {r: next((c for c in columns if any(h in c.lower() for h in hints)), None) for r, hints in HINTS.items()}
    return {r: c for r, c in found.items() if c is not None}


def _date(c: Column) -> Column:
    formats = ("yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yyyy", "d MMM yyyy")
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in formats])


def week_text(c: Column) -> Column:
    """The week from Monday to Sunday of a moment, as 'yyyy-MM-dd/yyyy-MM-dd'."""
    monday = F.date_trunc("week", c).cast("date")
    return F.concat_ws("/", F.date_format(monday, "yyyy-MM-dd"), F.date_format(F.date_add(monday, 6), "yyyy-MM-dd"))


def read_board(spark: SparkSession, path: str, project: str = "Board", today: str | None = None) -> DataFrame:
    """A board's CSV export in the older schema; cards without any due date all stand in the week of `today`."""
    df = read_csv(spark, path)
    low = {c.lower(): c for c in df.columns}
    pick = lambda *n: next((low[x] for x in n if x in low), None)
    task, desc, lane, team, due = pick("name", "task") or df.columns[0], pick("desc", "description"), pick("list", "status", "column"), pick("members", "assignees", "assigned_to"), pick("due", "deadline", "date")
    now = F.lit(today).cast("timestamp") if today else F.current_timestamp()
    some = df.where(F.col(due).isNotNull()).limit(1).count() if due else 0
    text_or = lambda c, d="": F.col(c) if c else F.lit(d)
    return df.select(
        "row_id", F.coalesce(task, F.lit("")).alias("Task"), F.lit(project).alias("Project"), text_or(desc).alias("Description"), text_or(team).alias("Assignees"), text_or(lane, "In Progress").alias("Status"),
        (week_text(_date(F.col(due))) if some else week_text(now)).alias("Week"), *[F.lit(0.0).alias(c) for c in ("Planned_Effort", "Actual_Effort", "Cost")],
    )


def map_schema(df: DataFrame, order: str = "row_id", today: str | None = None) -> DataFrame:
    """Any table in the older schema: columns by guess_column, numbers that can't be read 0, weeks filled forward."""
    cols = {t: guess_column(t, [c for c in df.columns if c != order]) for t in ALIASES}
    out = df.select(
        F.col(order), *[(F.col(f"`{cols[t]}`").cast("string") if cols[t] else F.lit("")).alias(t) for t in REQUIRED],
        *[(F.coalesce(to_number(F.col(f"`{cols[t]}`").cast("string")), F.lit(0.0)) if cols[t] else F.lit(0.0)).alias(t) for t in ("Planned_Effort", "Actual_Effort", "Cost")],
    )
    now = F.lit(today).cast("timestamp") if today else F.current_timestamp()
    d = out.withColumn("__d", _date(F.regexp_extract("Week", r"^([^/]*(?:/\d{2}/\d{4})?)", 1)))
    return fill_forward(d, "__d", order).withColumn("Week", week_text(F.coalesce("__d", now))).drop("__d")


# Worksheets


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


CELLS = "path string, sheet string, row_idx int, cells array<string>, sheet_idx int"


def workbook_cells(content: bytes) -> Iterator[tuple[str, int, list[str | None], int]]:
    """(sheet, row from 0, cells as text, place of the sheet in the workbook) of an .xlsx file's content."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        strings: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for si in ET.parse(z.open("xl/sharedStrings.xml")).getroot().findall("m:si", _NS):
                strings.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        rels = {r.get("Id"): r.get("Target") for r in ET.parse(z.open("xl/_rels/workbook.xml.rels")).getroot()}
        for place, sheet in enumerate(ET.parse(z.open("xl/workbook.xml")).getroot().find("m:sheets", _NS)):
            target = rels[sheet.get(_REL)].lstrip("/")
            target = target if target.startswith("xl/") else f"xl/{target}"
            for _, row in ET.iterparse(z.open(target)):
                if row.tag != f"{{{_NS['m']}}}row":
                    continue
                cells: list[str | None] = []
                for c in row.findall("m:c", _NS):
                    ref = re.match(r"[A-Z]+", c.get("r") or "")
                    at = _column(ref.group()) if ref else len(cells)
                    cells += [None] * (at - len(cells))
                    v, kind = c.find("m:v", _NS), c.get("t")
                    if kind == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                    else:
                        value = None if v is None else v.text
                        if kind == "s" and value is not None:
                            value = strings[int(value)]
                    cells.append(value)
                yield sheet.get("name"), int(row.get("r") or 1) - 1, cells, place
                row.clear()


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def read_workbook(spark: SparkSession, *paths: str) -> DataFrame:
    """The raw cells of .xlsx files on any file system Spark reads, one task for each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                rows = ((path, *r) for r in workbook_cells(content))
                while part := list(islice(rows, 10_000)):
                    yield pd.DataFrame(part, columns=["path", "sheet", "row_idx", "cells", "sheet_idx"])

    return spark.read.format("binaryFile").load(list(paths)).select("path", "content").mapInPandas(run, CELLS)


# Shared sheets through their service's interface


def _get(url: str, token: str) -> dict:
    request = urllib.request.Request(url, headers={"Authorization": f"Bearer {token}"} if token else {})
    with urllib.request.urlopen(request, timeout=60) as r:  # noqa: S310
        return json.load(r)


class _SheetReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.id, self.tab, self.token = options["id"], options.get("tab"), options.get("token", "")
        self.base = options.get("endpoint", "https://sheets.googleapis.com").rstrip("/") + f"/v4/spreadsheets/{self.id}"

    def partitions(self) -> list[InputPartition]:
        tabs = [s["properties"]["title"] for s in _get(f"{self.base}?fields=sheets.properties.title", self.token)["sheets"]]
        return [InputPartition((k, t)) for k, t in enumerate(tabs) if self.tab in (None, t)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        place, tab = partition.value
        rows = _get(f"{self.base}/values/{urllib.parse.quote(tab, safe='')}", self.token).get("values", [])
        for k, row in enumerate(rows):
            yield self.id, tab, k, [None if c is None else str(c) for c in row], place


class SheetSource(DataSource):
    """Data source 'sheet': the raw cells of a shared sheet, one task for each tab. Options: id, tab (none: all), token, endpoint."""

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _SheetReader(dict(self.options))


def read_sheet(spark: SparkSession, sheet_id: str, tab: str | None = None, token: str = "", endpoint: str | None = None) -> DataFrame:
    """The table of a shared sheet's tab under its detected header; without a tab, of the one that scores best, the first of equals."""
    spark.dataSource.register(SheetSource)
    options = {"id": sheet_id, "token": token} | ({"tab": tab} if tab else {}) | ({"endpoint": endpoint} if endpoint else {})
    cells = spark.read.format("sheet").options(**options).load()
    best = best_tab(cells).first()
    if best is None:
        raise ValueError("the sheet has no such tab with rows")
    return sheet_table(cells, sheet_id, best.sheet, best.header_row)


def best_tab(cells: DataFrame) -> DataFrame:
    """The one row (path, sheet, header_row, sheet_score) of the tab with the best sheet_score, the first of equals."""
    place = cells.groupBy("path", "sheet").agg(F.min("sheet_idx").alias("place"))
    return sheet_scores(cells, detect_headers(cells)).join(place, ["path", "sheet"]).orderBy(F.desc("sheet_score"), "place").limit(1).drop("place")


def header_score(cells: Column) -> Column:
    """+2 for each required name that stands alone in a cell, else +1 if an alias of it is contained in one."""
    low = F.transform(F.filter(cells, lambda x: x.isNotNull()), lambda x: F.lower(F.trim(x)))

    def has(words: tuple[str, ...]):  # noqa: ANN202
        return lambda x: F.greatest(*[x.contains(a).cast("int") for a in words]) > 0

    score = F.lit(0)
    for need in REQUIRED:
        alias = F.exists(low, has(ALIASES[need]))
        score = score + F.when(F.array_contains(low, need.lower()), 2).when(alias, 1).otherwise(0)
    return score


def _best_rows(scored: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("row_idx", "score"), F.struct("score", -F.col("row_idx")))
    return scored.groupBy("path", "sheet").agg(best.alias("b")).select("path", "sheet", F.col("b.row_idx").alias("header_row"), F.col("b.score").alias("score"))


def detect_headers(cells: DataFrame, scan: int = 30) -> DataFrame:
    """(path, sheet, header_row, score) of shared sheets: the best-scored row among the first of each, the first of equals."""
    return _best_rows(cells.where(F.col("row_idx") < scan).withColumn("score", header_score(F.col("cells"))))


def hint_score(cells: Column) -> Column:
    """+1 for each hint contained in the row's text, +1 for three cells or more up to the last filled one; null for blank rows."""
    texts = F.transform(cells, lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    filled = F.array_max(F.transform(texts, lambda x, i: F.when(x != "", i + 1)))
    low = F.lower(F.array_join(texts, " "))
    hints = sum((low.contains(h).cast("int") for words in HINTS.values() for h in words), F.lit(0))
    return F.when(filled.isNotNull(), hints + (filled >= 3).cast("int"))


def find_headers(cells: DataFrame, scan: int = 200) -> DataFrame:
    """(path, sheet, header_row, score) of workbooks: the first maximum of hint_score over the first rows, blank ones left out."""
    return _best_rows(cells.where(F.col("row_idx") < scan).withColumn("score", hint_score(F.col("cells"))).where(F.col("score").isNotNull()))


def sheet_scores(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(path, sheet, header_row, sheet_score): the header's score and a tenth of the rows below it, 20 at most."""
    n = cells.join(headers, ["path", "sheet"]).where("row_idx > header_row").groupBy("path", "sheet").agg(F.count(F.lit(1)).alias("n"))
    return headers.join(n, ["path", "sheet"], "left").select("path", "sheet", "header_row", (F.col("score") + F.floor(F.least(F.coalesce("n", F.lit(0)), F.lit(200)) / 10)).alias("sheet_score"))


# Words in the title of a sheet of tasks.
TITLE_HINTS = ("timeline", "task", "nhiệm vụ", "project", "dự án", "du an", "work", "backlog", "week", "sprint")
_ROLES_OF_SHEETS = ("task", "assignee", "week", "status", "planned", "project", "cost")


def title_scores(cells: DataFrame) -> DataFrame:
    """(path, sheet, place, sheet_score): 2 for a title with a hint, half a point for each hint that each of the first 8 rows contains."""
    hints = [h for r in _ROLES_OF_SHEETS for h in HINTS[r]]
    row = F.lower(F.array_join(F.transform("cells", lambda x: F.coalesce(x, F.lit(""))), " "))
    points = F.when(F.col("row_idx") < 8, sum((F.col("__row").contains(h).cast("int") for h in hints), F.lit(0)) * 0.5).otherwise(0.0)
    by = cells.withColumn("__row", row).groupBy("path", "sheet").agg(F.min("sheet_idx").alias("place"), F.sum(points).alias("p"))
    titled = F.greatest(*[F.lower("sheet").contains(h).cast("int") for h in TITLE_HINTS]) * 2.0
    return by.select("path", "sheet", "place", (F.col("p") + titled).alias("sheet_score"))


def sheet_table(cells: DataFrame, path: str, sheet: str, header_row: int) -> DataFrame:
    """One sheet as a table of text columns named by its header row; blank names are col_i, blank rows are dropped."""
    one = cells.where((F.col("path") == path) & (F.col("sheet") == sheet))
    head = one.where(F.col("row_idx") == header_row).select("cells").first()
    names, seen = [], set()
    for i, c in enumerate(head.cells if head else []):
        n = (c or "").strip() or f"col_{i}"
        while n.lower() in seen:
            n = f"{n}_{i}"
        seen.add(n.lower())
        names.append(n)
    body = one.where((F.col("row_idx") > header_row) & F.exists("cells", lambda x: F.length(F.trim(x)) > 0))
    return body.select(F.col("row_idx").cast("long").alias("row_id"), *[F.try_element_at("cells", F.lit(i + 1)).alias(n) for i, n in enumerate(names)])


def workbook_url(url: str) -> str:
    """The address of a shared sheet's whole workbook as .xlsx; other addresses as they are."""
    m = re.search(r"/spreadsheets/d/([^/]+)/", url)
    return f"https://docs.google.com/spreadsheets/d/{m.group(1)}/export?format=xlsx" if m and "docs.google.com/spreadsheets" in url else url


def ingest_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """The task table of a workbook (a file or a web address): the named sheet, else the one with the best title_scores, the first of equals."""
    file = _shared(spark, workbook_url(path), ".xlsx")
    cells = read_workbook(spark, file)
    scored = title_scores(cells)
    named = scored.where(F.col("sheet") == sheet).first() if sheet else None
    chosen = named or scored.orderBy(F.desc("sheet_score"), "place").first()
    header = chosen and find_headers(cells.where(F.col("sheet") == chosen.sheet)).first()
    if not header:
        raise ValueError("the workbook has no sheet with rows")
    return sheet_table(cells, header.path, chosen.sheet, header.header_row)


def synthetic(spark: SparkSession, n_tasks: int = 200, seed: int = 42, anchor: str = "2024-01-01") -> DataFrame:
    """Generated tasks in the older schema; every value hangs on the task's number and the seed only."""
    members = ["Ines Faber", "I. Faber", "Jonas Reiter", "Kaya Demir", "Lotte Brandt", "Milan Horvat"]
    topics = ["sql report", "rest gateway", "react form", "kotlin screen", "terraform module", "nlp labels", "figma sketch", "sprint board"]
    u = lambda k: uniform(F.concat_ws("-", F.lit(str(seed)), F.col("id").cast("string"), F.lit(k)))
    of = lambda values, x: F.element_at(F.array(*map(F.lit, values)), (F.floor(x * len(values)) + 1).cast("int"))
    size = F.when(u("n") < 0.7, 1).when(u("n") < 0.95, 2).otherwise(3)
    ranked = F.array_sort(F.array(*[F.struct(u(f"m{i}").alias("u"), F.lit(m).alias("m")) for i, m in enumerate(members)]))
    status = F.when(u("s") < 0.2, "Not Started").when(u("s") < 0.7, "In Progress").otherwise("Completed")
    # a sum of two exponentials of mean 2 has the Gamma(2, 2) distribution
    t = spark.range(n_tasks).withColumns({"Status": status, "plan": F.greatest(F.lit(1.0), -2 * F.log(u("p")) - 2 * F.log(u("q")))})
    t = t.withColumn("actual", F.when(F.col("Status") == "Completed", F.col("plan") * (0.7 + 0.6 * u("a"))).otherwise(0.0))
    monday = F.date_sub(F.date_trunc("week", F.lit(anchor).cast("timestamp")).cast("date"), (F.floor(u("w") * 21) * 7).cast("int"))
    return t.select(
        F.col("id").alias("row_id"), F.concat(F.lit("T"), "id").alias("Task"), of(["Harbour", "Lantern"], u("j")).alias("Project"), F.concat(F.lit("Piece "), "id", F.lit(" of the "), of(topics, u("k"))).alias("Description"),
        F.concat_ws("; ", F.transform(F.slice(ranked, F.lit(1), size), lambda x: x["m"])).alias("Assignees"), "Status", week_text(monday.cast("timestamp")).alias("Week"),
        F.col("plan").alias("Planned_Effort"), F.col("actual").alias("Actual_Effort"), (F.col("actual") * (5 + 10 * u("c"))).alias("Cost"),
    )


def load(spark: SparkSession, demo: int | None = None, board: str | None = None, csv: str | None = None, sheet: str | None = None, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """The first source given, in this order: generated tasks, a board export, a delimited file, a shared sheet."""
    if demo is not None:
        return synthetic(spark, demo)
    if board:
        return read_board(spark, board)
    if csv or sheet:
        return read_csv(spark, csv or sheet, sep, encoding)
    raise ValueError("no source given")
