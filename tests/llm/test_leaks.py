import random

import numpy as np

from planloom.llm.leaks import WindowIndex, leaks, simhashes
from planloom.llm.textfold import words

ITEM = "Une équipe de 21 personnes suit le tableau; la portée double au jour 31, et la marge baisse à 22 heures avant la fin du plan"


def pairs(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r.n_words for r in leaks(d, i, **kw).collect()}


def test_cases(spark):
    w = ITEM.split()
    docs = [
        (1, "before " + ITEM + " after"), (2, ITEM.upper().replace("É", "E").replace(" ", "\n ")), (3, " ".join(w[5:16])), (4, " ".join(w[5:17]) + ", other"), (5, None), (6, ""), (7, " ".join(w[:6] + ["x"] + w[6:14])),
        (1, "before " + ITEM + " after"), (8, "pad " * 20_000 + " ".join(w[3:20])),
    ]
    got = pairs(spark, docs, [(9, ITEM), (9, ITEM), (10, "too short"), (11, None)])
    assert set(got) == {(1, 9), (2, 9), (4, 9), (8, 9)} and got[4, 9] == 12 and got[1, 9] == len(words(ITEM))
    assert pairs(spark, docs, []) == {} and pairs(spark, [], [(9, ITEM)]) == {}


def test_similarity_of_windows():
    """Weighted Jaccard of shingles against the plain definition; equal windows are 1, reordered ones are less."""
    import math

    texts = [(1, "a b c d e f g h i j"), (2, "a b c d e x y z i j")]
    index = WindowIndex(texts, 8, 3, 5)
    windows = [tuple(t.split()[k : k + 8]) for _, t in texts for k in range(3)]
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(4)}
    df = {s: sum(s in shingles(w) for w in windows) for w in windows for s in shingles(w)}
    assert index.held == df
    weigh = lambda s: sum(math.log(1 + len(windows) / df.get(t, 1)) for t in s)
    for a in windows:
        for b in [*windows, tuple(reversed(a))]:
            want = 1.0 if a == b else weigh(shingles(a) & shingles(b)) / weigh(shingles(a) | shingles(b))
            assert abs(index.similarity(list(a), list(b)) - want) < 1e-12


def test_similar_windows_are_told_apart(spark):
    """At a lower similarity a window with another last word is accepted, but shares no run of n words."""
    text = " ".join(f"w{i}" for i in range(12))
    d = spark.createDataFrame([(1, text), (2, text[:-3] + "w1")], "doc_id long, text string")
    i = spark.createDataFrame([(9, text)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.similarity) for r in leaks(d, i, blocks=32, similarity=0.5).collect()}
    assert got[1] == (12, 1.0) and got[2][0] == 0 and 0.5 <= got[2][1] < 1


def test_item_blocks_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(30)) for i in range(40)]
    docs = [(i, text(40) + " " + " ".join(items[i % 40][1].split()[i % 9 : i % 9 + 10 + i % 6]) + " " + text(20)) for i in range(120)]
    n = 12
    want = {(d, i) for d, t in docs for i, s in items if {tuple(t.split()[k : k + n]) for k in range(len(t.split()) - n + 1)} & {tuple(s.split()[k : k + n]) for k in range(len(s.split()) - n + 1)}}
    assert set(pairs(spark, docs, items)) == want == set(pairs(spark, docs, items, max_windows=60))


def test_radius_is_complete():
    """Multi-index lookup finds every pair within blocks - 1 bits."""
    rng = np.random.default_rng(1)
    index = WindowIndex([(0, "a")], 1, 3, 5)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    index.prints, index.item, index.start = base, np.zeros(300, np.int32), np.zeros(300, np.int32)
    index.order = [np.argsort(index.block(base, b), kind="stable").astype(np.int32) for b in range(3)]
    index.values = [index.block(base, b)[o] for b, o in enumerate(index.order)]
    probe = base ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    i, j = index.candidates(probe)
    assert {(int(a), int(b)) for a, b in zip(i, j)} == {(a, b) for a in range(300) for b in range(300) if int(probe[a] ^ base[b]).bit_count() <= 2}
    assert len(simhashes(base[:5], 12)) == 0
