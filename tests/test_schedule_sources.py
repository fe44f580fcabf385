import zipfile

import pytest
from pyspark.sql import functions as F

from planloom.operators import forecast, schedule
from planloom.sinks import report
from planloom.sources import trackers


def plan(spark, f, tasks, deps):
    t = spark.createDataFrame([(n, d, i) for i, (n, d) in enumerate(tasks)], "id string, dur double, ordinal int")
    return {r.id: r for r in f(t, spark.createDataFrame(deps, "pred string, id string")).collect()}


def test_chain(spark):
    got = plan(spark, schedule.critical_path, [("A", 3.0), ("B", 2.0), ("C", 4.0), ("D", 1.0)], [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("ghost", "B"), ("A", "B")])
    assert got["D"].ef == 8 and got["B"].slack == 2 and {k for k, r in got.items() if r.critical} == {"A", "C", "D"}


def test_circle(spark):
    args = [("A", 1.0), ("B", 2.0), ("C", 3.0)], [("A", "B"), ("B", "A"), ("B", "C")]
    with pytest.raises(schedule.CircularDependency):
        plan(spark, schedule.critical_path, *args)
    got = plan(spark, schedule.schedule, *args)
    assert [(got[k].es, got[k].ef) for k in "ABC"] == [(0, 1), (1, 3), (3, 6)]
    assert got["A"].cycle_group == "A -> B" and got["C"].cycle_group is None


def test_two_circles_and_bridge(spark):
    deps = [("A", "B"), ("B", "A"), ("B", "M"), ("M", "X"), ("X", "Y"), ("Y", "X"), ("S", "S")]
    got = plan(spark, schedule.relaxed_path, [(k, 1.0) for k in "ABMXYS"], deps)
    assert got["A"].cycle_group == "A -> B" and got["X"].cycle_group == "X -> Y" and got["M"].cycle_group is None and got["S"].cycle_group == "S"
    assert got["Y"].ef == 5


def test_pert_is_seeded(spark):
    t = spark.createDataFrame([(i, 1.0, 2.0, 4.0) for i in range(5)], "id int, opt double, most double, pess double")
    crit = spark.createDataFrame([(i, i < 3) for i in range(5)], "id int, critical boolean")
    a = sorted(r.duration for r in schedule.pert_samples(t, crit, 50).collect())
    b = sorted(r.duration for r in schedule.pert_samples(t.repartition(3), crit, 50).collect())
    assert a == pytest.approx(b) and 3 < a[0] and a[-1] < 12


def test_pert_of_any_estimates(spark):
    t = spark.createDataFrame([("a", 5.0, 2.0, 4.0), ("b", 1.0, 9.0, 4.0), ("c", None, 3.0, 4.0), ("d", 1.0, None, 1.0)], "id string, opt double, most double, pess double")
    one = lambda i: [r.duration for r in schedule.pert_samples(t.where(f"id = '{i}'"), t.select("id", F.lit(True).alias("critical")), 50).collect()]
    assert set(one("a")) == {2.0} and set(one("c")) == {3.0} and set(one("d")) == {1.0}
    assert len(set(one("b"))) == 50 and 1 <= min(one("b")) < max(one("b")) <= 9


def test_pert_in_analysis(spark):
    from planloom.plans import pipeline

    rows = [(0, "A", "", 1.0, 100.0, 120.0, 200.0), (1, "B", "A", 4.0, None, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "row_id long, task string, depends_on string, effort_score double, Opt_Duration double, Most_Duration double, Pess_Duration double")
    results = pipeline.analyse(pipeline.from_canonical(df))
    d = [r.duration for r in results["08_pert_duration"].collect()]
    assert len(d) == 2000 and 103.2 <= min(d) < max(d) <= 205
    assert {r.id: r.duration for r in results["07_cpm"].collect()} == {"A": 120.0, "B": 4.0}


def test_forecasts(spark):
    vel = spark.createDataFrame([(w, 4.0) for w in range(6)], "week int, velocity double")
    rem = spark.createDataFrame([(12.0,)], "remaining_effort double")
    assert {r.weeks for r in forecast.eta_bootstrap(rem, vel, 20).collect()} == {3}
    assert forecast.holt([1.0, 2.0, 3.0, 4.0], 2) == pytest.approx([5.0, 6.0], abs=0.1)
    assert {r["mean"] for r in forecast.moving_average(vel).collect()} == {4.0}
    x = spark.createDataFrame([(i, 10.0 + i % 5 if i else 500.0) for i in range(100)], "i long, v double")
    flagged = forecast.anomalies(x, "v", ["i"]).where("anomaly = 1").collect()
    assert 0 in {r.i for r in flagged} and len(flagged) <= 10


def workbook(path, sheets):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            body = "".join(f'<row r="{k + 1}">' + "".join(f'<c r="{chr(65 + j)}{k + 1}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(r) if v is not None) + "</row>" for k, r in enumerate(rows))
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')


def test_workbook(spark, tmp_path):
    p = str(tmp_path / "a.xlsx")
    workbook(p, {"Notes": [["hello"]], "Plan": [["Our plan"], [None, "Task", "Assignees", "Status", "Week", None], ["x", "Build", "Ann; Bo", "done", "2", "z"], [None], ["y", "Test", None, "todo"]]})
    t = trackers.ingest_workbook(spark, p)
    assert t.columns == ["row_id", "col_0", "Task", "Assignees", "Status", "Week"]
    assert [(r.Task, r.Assignees, r.Week) for r in t.orderBy("row_id").collect()] == [("Build", "Ann; Bo", "2"), ("Test", None, None)]


def test_workbook_headers(spark, tmp_path):
    from planloom.plans import ingest
    p = str(tmp_path / "b.xlsx")
    deep = [[f"note {i}"] for i in range(150)] + [["No", "Task", "Assignees", "Status", "Week"], ["1", "Build the api", "Ann", "done", "2"]]
    vi = [["Kế hoạch"], ["STT", "Công việc", "Người đảm nhận", "Trạng thái", "Tuần"], ["1", "Viết báo cáo", "An", "xong", "3"]]
    workbook(p, {"Deep": deep, "Vi": vi, "Low": [*deep[:50] * 4, *deep[150:]]})
    assert [(r.Task, r.Assignees, r.Week) for r in trackers.ingest_workbook(spark, p, "Deep").collect()] == [("Build the api", "Ann", "2")]
    t = trackers.ingest_workbook(spark, p, "Vi")
    assert t.columns[1:] == vi[1]
    assert [(r.task, r.task_leader, r.week) for r in ingest.build_tasks(t).collect()] == [("Viết báo cáo", "An", 3)]
    found = {r.sheet: r.header_row for r in trackers.find_headers(trackers.read_workbook(spark, p)).collect()}
    assert found == {"Deep": 150, "Vi": 1, "Low": 0}  # row 201 is past the scan


def test_board_and_urls(spark, tmp_path):
    p = tmp_path / "b.csv"
    p.write_text('﻿Name,List,Members,Due\n"A, b",Doing,"Ann; Bo",2024-03-06T10:00:00.000Z\nC,,,\n', encoding="utf-8")
    r = trackers.read_board(spark, str(p), "P").orderBy("row_id").collect()
    assert (r[0].Task, r[0].Week, r[1].Task) == ("A, b", "2024-03-04/2024-03-10", "C")
    u = "https://docs.google.com/spreadsheets/d/abc-1/edit?gid=5#gid=7"
    assert trackers.sheet_export_url(u).endswith("/d/abc-1/export?format=csv&gid=7") and trackers.sheet_export_url("x") == "x"
    assert trackers.guess_column("Status", ["a", "My State"]) == "My State" and trackers.role_columns(["Công việc", "Owner"])["assignee"] == "Owner"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "ü"]), (2, None)], "i int, l array<string>")
    assert report.write_csv(df, str(tmp_path / "x.csv")) == 2
    raw = (tmp_path / "x.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf") and "ü".encode() in raw
    report.write_json(df, str(tmp_path / "x.json"))
    report.stage(df.withColumn("t", F.lit("a<b")), str(tmp_path / "s"), {"sheet": "Plan"})
    assert sorted(p.name for p in (tmp_path / "s").iterdir() if not p.name.startswith(".")) == ["diagnostics.csv", "diagnostics.json", "external_input.csv", "external_input.xlsx", "preview.html", "raw_snapshot.csv"]
    back = trackers.ingest_workbook(spark, str(tmp_path / "s/external_input.xlsx"))
    assert [(r.i, r.t) for r in back.orderBy("row_id").collect()] == [("1", "a<b"), ("2", "a<b")]
    assert report.safe_name("a/b:c.txt") == "abc.txt"


def test_pipeline_from_every_source(spark, tmp_path):
    from planloom.plans import pipeline

    t = trackers.synthetic(spark, 60)
    assert t.orderBy("row_id").collect() == trackers.synthetic(spark, 60).repartition(5).orderBy("row_id").collect()
    results = pipeline.analyse(pipeline.from_canonical(pipeline.from_legacy(t)))
    s = results["summary"].first()
    assert s.tasks == 60 and s.projects == 2 and results["07_cpm"].count() == 60
    assert results["01_burnup"].count() == results["03_burndown"].count() > 0


def test_build_tasks(spark):
    from planloom.plans import ingest

    rows = [
        (0, "Fix  the api", "Alice Nguyen; Bo Tran", "doing", "2", "", "1,5"), (1, "Fix the api", "Alice Nguyen", "done", "3", "P", None), (2, "Monday", "Ann", "done", "3", "P", None), (3, "Test it", "", "done", "3", "P", None),
        (4, "Fix  the api", "Alice Nguyen + X", "todo", None, "", None), (5, "Deploy docker", "Alice Nguyn", "finished", "x", "P", "7"),
    ]
    raw = spark.createDataFrame(rows, "row_id long, `Work item` string, Owner string, Status string, Week string, Project string, Estimate string")
    got = {r.row_id: r for r in ingest.build_tasks(raw, "Board").collect()}
    assert sorted(got) == [0, 1, 5]
    assert (got[0].project, got[0].task, got[0].planned_effort, got[0].week, got[0].completion_status) == ("Board", "Fix the api", 1.5, 2, "In Progress")
    assert got[5].task_leader == got[0].task_leader == "Alice Nguyn" and got[0].assignees_list == '["Alice Nguyn","Bo Tran"]'
    assert got[5].week == 3 and got[1].completion_status == "Completed" and '"DevOps"' in got[5].skills


def test_build_without_hints(spark):
    from planloom.plans import ingest

    raw = spark.createDataFrame([(i, f"some longer text {i}", "Ann", f"{i + 1:02d}/03/2024", "x" if i % 2 else "") for i in range(10)], "row_id long, blah string, owner string, `due date` string, `done?` string")
    got = {r.row_id: r for r in ingest.build_tasks(raw, "S", merge=False).collect()}
    assert [got[i].week for i in (0, 2, 3, 9)] == [1, 1, 2, 2] and got[1].completion_status == "Completed" and got[0].completion_status == "Not Started"
    assert got[0].actual_cost == got[0].effort_score * 150


def test_sheet_choice(spark, tmp_path):
    """By title and hints of the first rows, the first of equals; an unknown name falls back to that."""
    p = str(tmp_path / "c.xlsx")
    workbook(p, {"Notes": [["a", "b", "c"]] * 40, "Sprint": [["x"], ["Task", "Owner"], ["Do", "Ann"]], "Backlog": [["x"], ["Task", "Owner"], ["Else", "Bo"]]})
    assert [r.Task for r in trackers.ingest_workbook(spark, p).collect()] == ["Do"]
    assert [r.Task for r in trackers.ingest_workbook(spark, p, "Backlog").collect()] == ["Else"]
    assert [r.Task for r in trackers.ingest_workbook(spark, p, "nowhere").collect()] == ["Do"]
    assert trackers.workbook_url("https://docs.google.com/spreadsheets/d/ab1/edit#gid=3") == "https://docs.google.com/spreadsheets/d/ab1/export?format=xlsx" and trackers.workbook_url("p.xlsx") == "p.xlsx"


@pytest.fixture
def service(tmp_path):
    """A local server with a workbook and a sheet service."""
    import http.server
    import json
    import threading
    import urllib.parse

    p = tmp_path / "w.xlsx"
    workbook(str(p), {"Tasks": [["Task", "Owner"], ["Do", "Ann"]]})
    tabs = {"Notes": [["hello"]], "My plan": [["Plan"], ["Task", "Project", "Assignees", "Status"], ["Do", "P", "Ann", "done"], ["Else", "P"]]}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            path = urllib.parse.urlparse(self.path).path
            if path == "/w.xlsx":
                body = p.read_bytes()
            elif path == "/v4/spreadsheets/S":
                body = json.dumps({"sheets": [{"properties": {"title": t}} for t in tabs]}).encode()
            else:
                body = json.dumps({"values": tabs[urllib.parse.unquote(path.rsplit("/", 1)[1])]}).encode()
            self.send_response(200 if self.headers.get("Authorization") == "Bearer k" or path == "/w.xlsx" else 403)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_from_the_web(spark, service):
    assert [(r.Task, r.Owner) for r in trackers.ingest_workbook(spark, f"{service}/w.xlsx").collect()] == [("Do", "Ann")]
    t = trackers.read_sheet(spark, "S", token="k", endpoint=service)
    assert [(r.Task, r.Project, r.Status) for r in t.orderBy("row_id").collect()] == [("Do", "P", "done"), ("Else", "P", None)]
    assert [r.hello for r in trackers.read_sheet(spark, "S", "Notes", "k", service).collect()] == []


def test_failures_are_told(spark, tmp_path):
    from planloom.plans import pipeline

    good = spark.createDataFrame([(1,)], "i int")
    bad = good.select(F.raise_error(F.lit("no")).alias("x"))
    failed = pipeline.write({"a": good, "b": bad}, str(tmp_path))
    assert len(failed) == 1 and failed[0].startswith("b:") and (tmp_path / "a.csv").exists() and (tmp_path / "failed.txt").exists()
    assert pipeline.write({"07_cpm": good}, str(tmp_path)) == [] and (tmp_path / "07_cpm").is_dir()
