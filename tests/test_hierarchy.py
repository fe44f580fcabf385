import random

from planloom.operators.hierarchy import descendants, hierarchy


def tree(spark, rows, paths=True):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id long, task string, up string")
    return {r.name: r for r in hierarchy(df, "task", "up", "row_id", paths).collect()}


def test_small(spark):
    got = tree(spark, [
        ("A", None), ("B", ' "a" '), ("C", "[B];"), ("D", "nobody"), ("E", ""), ("X", "Y"), ("Y", "Z"), ("Z", "X"), ("W", "x"), ("S", "S"), ("B", "C"), (None, "A"), ("  ", "A"),
    ])
    assert {k: (r.root, r.depth) for k, r in got.items()} == {
        "A": ("A", 0), "B": ("A", 1), "C": ("A", 2), "D": ("D", 0), "E": ("E", 0), "X": ("X", -1), "Y": ("X", -1), "Z": ("X", -1), "W": ("X", -1), "S": ("S", -1),
    }
    assert got["C"].path == ["A", "B", "C"] and got["A"].n_descendants == 2 and got["X"].path is None


def test_random_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(f"n{i}", f"n{rng.randrange(i)}" if i and rng.random() < 0.9 else None) for i in range(400)]
    rows += [(f"c{i}", f"c{(i + 1) % 9}") for i in range(9)] + [(f"d{i}", f"c{i}" if i < 3 else f"d{i - 3}") for i in range(12)] + [(f"l{i}", f"l{i - 1}" if i else None) for i in range(70)]
    up = dict(rows)
    got = tree(spark, rows)
    below = dict.fromkeys(up, 0)
    for t in up:
        seen, x = [], t
        while x is not None and x not in seen:
            seen.append(x)
            x = up[x]
        if x is None:
            assert (got[t].root, got[t].depth, got[t].path) == (seen[-1], len(seen) - 1, seen[::-1])
            for y in seen[1:]:
                below[y] += 1
        else:
            assert (got[t].root, got[t].depth) == (min(seen[seen.index(x):]), -1)
    for t, r in got.items():
        if r.depth >= 0:
            assert r.n_descendants == below[t]
            p = got[up[t]] if up[t] else None
            assert p is None or p.first < r.first <= p.first + p.n_descendants


def test_star_and_empty(spark):
    got = tree(spark, [("r", None), *[(f"k{i}", "r") for i in range(300)]], paths=False)
    assert got["r"].n_descendants == 300 and sorted(r.first for r in got.values()) == list(range(301))
    assert tree(spark, []) == {}


def test_descendants(spark):
    """Chains, stars and a circle; blocks of any size give the same pairs."""
    rows = [("r", None), *[(f"k{i}", "r") for i in range(9)], *[(f"l{i}", f"l{i - 1}" if i else "k3") for i in range(12)], ("x", "y"), ("y", "x")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id long, task string, up string")
    up = dict(rows)
    want = set()
    for t in up:
        x, d = up[t], 1
        while x is not None and t not in ("x", "y"):
            want.add((x, t, d))
            x, d = up[x], d + 1
    t = hierarchy(df, "task", "up", "row_id", paths=False)
    for block in (1, 5, 4096):
        got = [tuple(r) for r in descendants(t, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
