import pytest
from pyspark.sql import functions as F

from planloom.functions import text
from planloom.operators import people, similarity


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize(("value", "want"), [("incomplete", "Completed"), ("", "Not Started"), (None, "Not Started"), ("in progress - done", "In Progress"), ("blocked", "In Progress")])
def test_status(spark, value, want):
    assert one(spark, text.status_value, value) == want


def test_small_functions(spark):
    assert one(spark, text.to_number, "1,5") == 1.5 and one(spark, text.to_number, "1,234.5") is None and one(spark, text.to_number, "nan") is None
    assert one(spark, text.split_people, "Ann + Bob;Cy / Di") == ["Ann", "Bob", "Cy", "Di"]
    assert one(spark, text.effort_estimate, "api design") == pytest.approx(2.6)
    assert one(spark, text.skill_tags, "build rest api with docker") == ["Backend", "DevOps"]
    assert one(spark, text.list_of, '["a", "b"]') == ["a", "b"] and one(spark, text.list_of, "[broken") == [] and one(spark, text.list_of, None) == []
    assert one(spark, text.dependencies, "a; b,c d") == ["a", "b", "c", "d"]
    assert one(spark, text.task_skills, "deploy docker api") == ["DevOps", "Backend"]
    assert one(spark, text.task_skills, "") == ["General"]


def test_weeks(spark):
    df = spark.createDataFrame(list(enumerate(["2", None, "x", "-1", "3.9"])), "row_id long, w string")
    assert [r.week_no for r in text.week_numbers(df, "w", "row_id").orderBy("row_id").collect()] == [2, 2, 2, 1, 3]
    bad = spark.createDataFrame([(5, "a"), (9, "b")], "row_id long, w string")
    assert [r.week_no for r in text.week_numbers(bad, "w", "row_id").orderBy("row_id").collect()] == [1, 2]


def test_collapse(spark):
    df = spark.createDataFrame([("todo",), ("done",)], "s string")
    assert sorted(r.s for r in text.collapsed_status(df, "s").collect()) == ["Completed", "In Progress"]


def test_people(spark):
    ex = spark.createDataFrame([("t1", "a"), ("t2", "a"), ("t2", "b")], "task string, member string")
    got = {r.member: (r.degree_tasks, r.solo_tasks, round(r.key_person_index, 9)) for r in people.bus_factor(ex).collect()}
    assert got == {"a": (2.0, 1.0, 0.65), "b": (1.0, 0.0, 0.15)}
    t = spark.createDataFrame([("p", "t1", 6.0, ["a", "b"]), ("p", "t2", 4.0, ["a"])], "project string, task string, effort double, assignees array<string>")
    assert {r.member: r.contribution_pct for r in people.contribution(t).collect()} == {"a": 70.0, "b": 30.0}
    assert {r.member: r.value for r in people.contribution(t, 200).collect()} == {"a": 604.0, "b": 600.0}


def test_priority(spark):
    cols = "project string, task string, business_value double, time_criticality double, risk_reduction double, job_size double, reach double, impact double, confidence double, effort double, effort_score double"
    r = people.priority(spark.createDataFrame([("p", "t", 5.0, 3.0, 2.0, 4.0, 100.0, 2.0, None, 5.0, 1.0)], cols)).first()
    assert (r.wsjf, r.rice) == (2.5, pytest.approx(28))


def test_names(spark):
    n = spark.createDataFrame([("Alice Nguyen",), ("Alice Nguyn",), ("Bob Tran",), (None,), (" ",)], "n string")
    got = {r.name: r.canonical for r in similarity.greedy_groups(n, "n").collect()}
    assert got == {"Alice Nguyen": "Alice Nguyn", "Alice Nguyn": "Alice Nguyn", "Bob Tran": "Bob Tran"}


def test_link_entities(spark):
    """Against the groups taken one after the other."""
    import difflib
    import random

    rng = random.Random(5)
    people = ["Alice Nguyen", "Đặng Thu", "Bob Lund", "Bo", "Maria de la Cruz", "???", "!!"]

    def typed():
        n = list(rng.choice(people))
        if rng.random() < 0.5:
            n.insert(rng.randrange(len(n) + 1), rng.choice("aenx"))
        return "".join(n)

    rows = [(i, "; ".join(typed() for _ in range(rng.randrange(4)))) for i in range(60)] + [(60, None), (61, " ;; "), (62, "Alice Nguyen / Alice Nguyn, Bob")]
    groups: list[tuple[str, list[str]]] = []
    lists = {i: [x.strip() for x in (s or "").replace("/", ";").replace(",", ";").split(";") if x.strip()] for i, s in rows}
    for n in dict.fromkeys(x for i in sorted(lists) for x in lists[i]):
        k = similarity.bare(n)
        for first, members in groups:
            if difflib.SequenceMatcher(None, k, first).ratio() >= 0.92:
                members.append(n)
                break
        else:
            groups.append((k, [n]))
    canonical = {m: min(ms, key=lambda x: (-len(x), x)) for _, ms in groups for m in ms}
    df = spark.createDataFrame(rows, "row_id long, people string")
    got = {r.row_id: r for r in similarity.link_entities(df, "people", "row_id").collect()}
    assert {i: r.assignees_list for i, r in got.items()} == {i: [canonical[x] for x in v] for i, v in lists.items()}
    assert got[60].assigned_member == "" and got[62].assigned_member == canonical["Alice Nguyen"]


def test_similar_pairs_lose_none(spark):
    import itertools
    import random

    rng = random.Random(3)
    base = ["martha", "marhta", "jonathan", "jonathon", "dwayne", "duane", "katherine", "catherine"]
    names = sorted({"".join(rng.sample(b, len(b))) if rng.random() < 0.2 else b[: rng.randint(3, len(b))] + rng.choice("abx") for b in base * 12} | set(base))
    want = {(a, b) for a, b in itertools.combinations(names, 2) if round(similarity.jaro_winkler(a, b), 9) >= 0.85}
    got = similarity.similar_pairs(spark.createDataFrame([(x,) for x in names], "n string"), "n", 0.85).collect()
    assert {(r.name_a, r.name_b) for r in got} == want


def test_linked_names_meet_all_alike_and_few_others(spark):
    """Pairs are compared where they meet: none within the ratio is missing, and anagrams and common letters move no rows."""
    import difflib
    import random

    r = random.Random(5)
    part = ["ma", "ri", "an", "el", "tor", "vel", "kin", "sk", "o", "da", "x1 "]
    names = {"".join(r.choice(part) for _ in range(r.choice([1, 2, 4, 8, 9, 20]))).strip() for _ in range(120)}
    for s in list(names):
        for _ in range(2):
            i = r.randrange(len(s))
            names |= {s[:i] + s[i + 1 :], s[:i] + r.choice("abq ") + s[i:]}
    names = sorted(n for n in names if n)
    met = [tuple(x) for x in similarity._met(spark.createDataFrame([(n,) for n in names], "name string"), lambda s: s, 0.92, 0.92 / 1.08, 3, 0.08).distinct().collect()]
    pairs = {tuple(sorted(p)) for p in met}
    alike = {(s, t) for s in names for t in names if s < t and max(difflib.SequenceMatcher(None, s, t).ratio(), difflib.SequenceMatcher(None, t, s).ratio()) >= 0.92}
    assert alike and alike <= pairs and len(pairs) < 3 * len(alike)
