"""Writers of results: delimited files with a byte-order mark, JSON, tables, HTML previews, a text report."""

from __future__ import annotations

import csv
import decimal
import html
import json
import math
import os
import re
import shutil
import zipfile
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def safe_name(s: str) -> str:
    return re.sub(r"[^\w\-. ]", "", s, flags=re.UNICODE).strip() or "unnamed"


def write_table(df: DataFrame, path: str) -> None:
    """The way for results of any size: parquet, written in parallel."""
    df.write.mode("overwrite").parquet(path)


def _flat(df: DataFrame) -> list:
    return [F.to_json(F.struct(F.col(c).alias("v"))).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]


def write_csv(df: DataFrame, path: str) -> int:
    """One UTF-8 file with byte-order mark for a report; rows stream through the driver partition by partition."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    n = 0
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f)
        w.writerow(df.columns)
        for r in df.select(*_flat(df)).toLocalIterator():
            w.writerow(["" if v is None else v for v in r])
            n += 1
    return n


def write_json(df: DataFrame, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump([json.loads(r) for r in df.toJSON().toLocalIterator()], f, ensure_ascii=False, indent=1)


SHEET_ROWS = 1 << 20  # by format


def write_xlsx(df: DataFrame, path: str) -> int:
    """A workbook of text and number cells; rows stream through the driver, a further sheet begins where one is full."""
    head = [f'<c t="inlineStr"><is><t xml:space="preserve">{html.escape(c)}</t></is></c>' for c in df.columns]
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        rows = df.select(*_flat(df)).toLocalIterator()
        sheets = 0
        more = True
        while more:
            sheets += 1
            more = False
            with z.open(f"xl/worksheets/sheet{sheets}.xml", "w", force_zip64=True) as f:
                f.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetData><row r="1">{"".join(head)}</row>'.encode())
                for k, r in enumerate(rows, 2):
                    f.write(f'<row r="{k}">{"".join(map(_cell, r))}</row>'.encode("utf-8", "replace"))
                    n += 1
                    if k == SHEET_ROWS:
                        more = True
                        break
                f.write(b"</sheetData></worksheet>")
        ids = range(1, sheets + 1)
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_DOC}"><sheets>' + "".join(f'<sheet name="data{i if i > 1 else ""}" sheetId="{i}" r:id="rId{i}"/>' for i in ids) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACK}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_DOC}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in ids) + "</Relationships>")
        z.writestr("_rels/.rels", f'<Relationships xmlns="{_PACK}/relationships"><Relationship Id="rId1" Type="{_DOC}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_KIND}.worksheet+xml"/>' for i in ids)
        z.writestr("[Content_Types].xml", f'<Types xmlns="{_PACK}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_KIND}.sheet.main+xml"/>{types}</Types>')
    return n


_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACK = "http://schemas.openxmlformats.org/package/2006"
_KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def _cell(v: object) -> str:
    if v is None:
        return "<c/>"
    if isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool) and math.isfinite(v):
        return f"<c><v>{v}</v></c>"
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))
    return f'<c t="inlineStr"><is><t xml:space="preserve">{html.escape(text)}</t></is></c>'


def preview_html(df: DataFrame, path: str, rows: int = 200) -> None:
    """The first rows as an HTML table."""
    body = ["<tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in df.columns) + "</tr>"]
    body += ["<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in df.limit(rows).collect()]
    with open(path, "w", encoding="utf-8") as f:
        f.write("<meta charset='utf-8'><table border='1'>\n" + "\n".join(body) + "\n</table>\n")


def stage(df: DataFrame, folder: str, diagnostics: Mapping[str, object] | None = None) -> dict[str, object]:
    """A canonical table staged for a run: external_input.csv and .xlsx, raw_snapshot.csv, preview.html, diagnostics.json and .csv."""
    os.makedirs(folder, exist_ok=True)
    n = write_csv(df, f"{folder}/external_input.csv")
    shutil.copyfile(f"{folder}/external_input.csv", f"{folder}/raw_snapshot.csv")
    write_xlsx(df, f"{folder}/external_input.xlsx")
    preview_html(df, f"{folder}/preview.html")
    about = {"rows": n, "columns": df.columns, **(diagnostics or {})}
    with open(f"{folder}/diagnostics.json", "w", encoding="utf-8") as f:
        json.dump(about, f, ensure_ascii=False, default=str)
    with open(f"{folder}/diagnostics.csv", "w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f)
        w.writerow(about)
        w.writerow([v if isinstance(v, (str, int, float)) else json.dumps(v, ensure_ascii=False, default=str) for v in about.values()])
    return about


def text_report(summary: DataFrame, path: str) -> None:
    """The one-row summary as lines 'name: value'; rendering of charts is left to the reader's tools."""
    row = summary.first()
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(f"{k}: {v}\n" for k, v in (row.asDict() if row else {}).items())
