"""Schedules of random graphs against plain loops."""

import random

from planloom.operators import schedule


def plain(dur, deps):
    """Longest ends and tails by repeated passes; None where a circle stands before."""
    end, todo = {}, set(dur)
    while ready := [t for t in todo if all(p in end for p, q in deps if q == t)]:
        for t in ready:
            end[t] = dur[t] + max((end[p] for p, q in deps if q == t), default=0.0)
            todo.discard(t)
    return end


def test_against_loops(spark):
    for seed in range(3):
        rng = random.Random(seed)
        n = 60
        dur = {i: float(rng.randrange(0, 9)) for i in range(n)}
        deps = {(rng.randrange(i), i) for i in range(1, n) if rng.random() < 0.9}
        deps |= {(rng.randrange(i), i) for i in range(1, n) if rng.random() < 0.4} | {(i, i + 1) for i in range(40, 59)}
        end, tail = plain(dur, deps), plain(dur, {(q, p) for p, q in deps})
        tasks = spark.createDataFrame([(i, d, i) for i, d in dur.items()], "id long, dur double, ordinal long")
        edges = spark.createDataFrame(sorted(deps), "pred long, id long")
        got = {r.id: r for r in schedule.critical_path(tasks, edges).collect()}
        total = max(end.values())
        assert {i: (r.ef, r.ls) for i, r in got.items()} == {i: (end[i], total - tail[i]) for i in dur}
        # circles: closed ones with trees behind them, and ones through joins
        deps |= {(59, 50), (61, 62), (62, 63), (63, 61), (63, 64), (64, 65), (65, 3)}
        dur |= {i: 1.0 for i in range(61, 66)}
        reach = {a: {a} for a in dur}
        for _ in dur:
            for p, q in deps:
                for a in dur:
                    if p in reach[a]:
                        reach[a].add(q)
        comp = {a: max(b for b in dur if b in reach[a] and a in reach[b]) for a in dur}
        nodes, e2 = schedule.graph(spark.createDataFrame([(i, d, i) for i, d in dur.items()], "id long, dur double, ordinal long"), spark.createDataFrame(sorted(deps), "pred long, id long"))
        assert {r.id: r.comp for r in schedule.circles(nodes, e2).collect()} == comp


def test_long_chain_in_few_rounds(spark):
    n = 3000
    tasks = spark.range(n).selectExpr("id", "1.0D AS dur", "id AS ordinal")
    deps = spark.range(n - 1).selectExpr("id AS pred", "id + 1 AS id")
    r = schedule.critical_path(tasks, deps).selectExpr("max(ef) AS e", "count_if(critical) AS n").first()
    assert (r.e, r.n) == (n, n)
