from planloom.llm.names import Name, compare, link_names, variant_pairs

NONE = lambda _: 0

PEOPLE = {
    1: ["Philippa Kreshelmore", "Kreshelmore, P.", "Philippa", "Philippa Rkeshelmore", "pkreshelmore", "Kreshelmore Philippa", "Pippa Kreshelmore", "philippa_kreshelmore", "Dr. Philippa Kreshelmore", "Philippa B. Kreshelmore", "PHILIPPA  KRESHELMORE"],
    2: ["Ingrid Kreshelmore", "Ingrid K.", "ingrid.kreshelmore"],
    3: ["Sören van Halötz", "Soren van Halotz", "van Halötz, Sören", "Sören vann Halötz"],
    4: ["Kordia Engineering GmbH", "Kordia Eng. GmbH", "The Kordia Engineering GmbH", "Kordia-Engineering GmbH", "kordia engineering", "Kordia Engineering HmbH"],
    5: ["Kordia Systems Ltd", "Kordia Sys. Ltd", "KORDIA SYSTEMS LIMITED"],
}


def linked(spark, rows, **kw):
    return link_names(spark.createDataFrame(rows, "project string, name string"), **kw)


def entities(df):
    """The sets of names that belong together, whatever their numbers."""
    sets = {}
    for r in df.collect():
        sets.setdefault((r.project, r.entity), set()).add(r.name)
    return sorted((g, sorted(s)) for (g, _), s in sets.items())


def test_groups(spark):
    rows = [("p", n) for ns in PEOPLE.values() for n in ns] + [("q", "Philippa Kreshelmore"), ("q", "Philippa"), ("p", None), (None, "Ann"), ("p", "  ")] + [("p", "Philippa")] * 50
    got = linked(spark, rows).collect()
    of = {(r.project, r.name): r.entity for r in got}
    assert len(got) == len(of) == sum(map(len, PEOPLE.values())) + 2
    entities = [{of["p", n] for n in ns} for ns in PEOPLE.values()]
    assert all(len(e) == 1 for e in entities) and len(set.union(*entities)) == len(PEOPLE)
    assert of["q", "Philippa"] == of["q", "Philippa Kreshelmore"] != of["p", "Philippa"]
    pairs = {tuple(r) for r in variant_pairs(linked(spark, [("p", "Bob Lund"), ("p", "Robert Lund"), ("p", "robert lund"), ("p", "Ann Lund")])).collect()}
    assert pairs == {("p", "Bob Lund", "Robert Lund"), ("p", "Bob Lund", "robert lund"), ("p", "Robert Lund", "robert lund")}


def test_settings_change_nothing(spark):
    """Blocks of hot grams, vectors by join instead of broadcast, and linkage by rounds give the same entities."""
    rows = [(g, n) for g in "pq" for ns in PEOPLE.values() for n in ns] + [("p", f"Tor Lund{i}") for i in range(30)]
    whole = entities(linked(spark, rows))
    assert entities(linked(spark, rows, block=3)) == whole
    assert entities(linked(spark, rows, most_grams=0)) == whole
    assert entities(linked(spark, rows, component=1)) == whole


def test_linkage_against_closest_first():
    """Random sparse scores without ties against joining the closest pair of all, one at a time."""
    import random

    from planloom.llm.names import average_linkage

    for seed in range(30):
        rng = random.Random(seed)
        n = rng.randrange(2, 14)
        score = {(i, j): rng.random() for i in range(n) for j in range(i + 1, n) if rng.random() < 0.6}
        groups = [{i} for i in range(n)]
        while True:
            best = max(((sum(score.get((min(i, j), max(i, j)), 0) for i in x for j in y) / (len(x) * len(y)), a, b) for a, x in enumerate(groups) for b, y in enumerate(groups) if a < b), default=(0, 0, 0))
            if best[0] < 0.3:
                break
            groups[best[1]] |= groups.pop(best[2])
        label = average_linkage(list(range(n)), [(i, j, s) for (i, j), s in score.items()], 0.3)
        assert {i: min(next(g for g in groups if i in g)) for i in range(n)} == label


def test_assignment_of_any_length():
    """The Hungarian method finds the best assignment; names of seven tokens follow the rule of six."""
    import random
    from itertools import permutations

    from planloom.llm.names import _hungarian

    for seed in range(40):
        rng = random.Random(seed)
        n = rng.randrange(1, 6)
        cost = [[rng.randrange(20) for _ in range(n)] for _ in range(n)]
        match = _hungarian(cost)
        assert sorted(match) == list(range(n)) and sum(cost[i][match[i]] for i in range(n)) == min(sum(cost[i][p[i]] for i in range(n)) for p in permutations(range(n)))
    for rest in ("Ana Luz Vega Sol Mar", "Ana Luz Vega Sol Mar Rey", "Ana Luz Vega Sol Mar Rey Gil Paz Oro Cid Lar Nox"):
        full, short = compare(Name(f"Robert {rest}"), Name(f"Bob {rest}"), NONE)
        assert full > 0.98 and short
        assert compare(Name(f"Robert {rest}"), Name(f"{rest} R."), NONE)[0] > 0.9
        assert compare(Name(f"Robert {rest}"), Name(f"Theo {rest}"), NONE)[0] == 0.0


def test_empty(spark):
    assert linked(spark, []).collect() == []


def test_compare():
    assert compare(Name("Anh Lund"), Name("Ann Lund"), lambda t: 9)[0] == 0.0  # two names in use
    assert compare(Name("A. Lund"), Name("Anh Lund"), NONE)[0] > 0.8
    assert compare(Name("Tor B. Lund"), Name("Tor Lund"), NONE) == (1.0, True)
    assert compare(Name("Pell Systems Inc"), Name("Pell Systems Co."), NONE)[0] < 0.7
    assert compare(Name("..."), Name("Ann"), NONE) == (0.0, False)
