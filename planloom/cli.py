"""python -m planloom.cli run|ingest: a tracker's export in, results out."""

from __future__ import annotations

import argparse
import sys

from planloom.plans import ingest, pipeline
from planloom.session import get_session
from planloom.sinks import report
from planloom.sources import trackers

LEGACY = {"task", "project", "description", "assignees", "status", "week"}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="planloom")
    sub = p.add_subparsers(dest="what", required=True)
    run = sub.add_parser("run", help="analyse a source")
    run.add_argument("--demo-tasks", type=int)
    run.add_argument("--board-csv")
    run.add_argument("--csv")
    run.add_argument("--sheet-url")
    run.add_argument("--sep", default=",")
    run.add_argument("--encoding", default="UTF-8")
    run.add_argument("--out", required=True)
    ing = sub.add_parser("ingest", help="stage a workbook and analyse it")
    ing.add_argument("--in", dest="source", required=True)
    ing.add_argument("--sheet")
    ing.add_argument("--staging", required=True)
    ing.add_argument("--out", required=True)
    for c in (run, ing):
        c.add_argument("--form", choices=("mixed", "tables", "csv"), default="mixed", help="results of a row for each task or member as tables and the rest as files, all as tables, or all as files")
    a = p.parse_args(argv)
    spark = get_session()
    if a.what == "run":
        df = trackers.load(spark, a.demo_tasks, a.board_csv, a.csv, a.sheet_url, a.sep, a.encoding)
    else:
        df = ingest.build_tasks(trackers.ingest_workbook(spark, a.source, a.sheet), a.sheet or "")
        report.stage(df, a.staging)
    names = {c.lower() for c in df.columns}
    if not {"completion_status", "effort_score"} & names:
        df = pipeline.from_legacy(df if LEGACY <= names and "planned_effort" in names else trackers.map_schema(df))
    failed = pipeline.write(pipeline.analyse(pipeline.from_canonical(df)), a.out, {"mixed": None, "tables": True, "csv": False}[a.form])
    for f in failed:
        print("failed:", f, file=sys.stderr)
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
