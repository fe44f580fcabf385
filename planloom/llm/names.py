"""Variant spellings of names within a group: sparse cosine joins and average-linkage clustering.

1. Each distinct name of a group becomes a unit vector of weighted character 2- and 3-grams of its
   folded tokens (nicknames add their long form). Weights come from exact counts of all grams.
2. A sparse cosine join finds all pairs of a group with cosine >= `cosine`: grams are ordered rarest
   first, and only the prefix is joined whose remainder weighs less than the threshold. The first
   common gram of a pair over the threshold lies in both prefixes, so no pair is lost.
3. Each candidate is scored token by token (typing errors, initials, swapped parts, nicknames, user
   names, firms' legal forms), tokens paired by the best assignment whatever their number. Two
   spellings of a token that are both in use in four groups or more, neither under 15 % of the other,
   are two names, not variants. Full names that agree are strong pairs.
4. Components of strong pairs are clustered by average linkage over the sparse scores (a pair that is
   no candidate counts 0): clusters that are each other's closest are joined, round by round, which
   gives the same clusters as joining the closest pair first.
5. Short forms (initials, a given name alone, user names) form clusters of their own and join the
   full cluster with the highest average similarity.

Scale: nothing is compared outside its group and candidate pairs. A gram of a hot group is joined in
blocks of `block` names. Weights are broadcast up to `most_grams` grams; beyond, vectors are joined to
the names instead. Components are labelled by joins; those of up to `component` names are linked in
one task each, larger ones by the same rounds as joins.

Defined results
- null and blank names, and names of a null group: not linked. Repeated names count once.
- strings are told apart as stored. Ties between clusters: the larger, then the one with the smallest id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planloom.llm.edits import edits
from planloom.llm.textfold import fold
from planloom.session import Scratch, cut

# Titles, particles, legal forms and short forms of given names.
TITLES = frozenset("mr mrs ms miss mx dr prof professor sir eng ing engr herr frau mme mlle madame monsieur sr sra srta dipl phd dott anh chi ong ba".split()) - {"anh"}
PARTICLES = frozenset("van von der den de di del della la le du da dos".split())
LEGAL = {
    "inc": "incorporated", "incorporated": "incorporated", "ltd": "limited", "limited": "limited", "co": "company", "company": "company", "gmbh": "gmbh", "llc": "llc",
    "corp": "corporation", "corporation": "corporation", "plc": "plc", "ag": "ag", "sarl": "sarl", "srl": "srl", "bv": "bv", "kg": "kg",
}
NICKNAMES = {
    "abigail": "abby gail abbie", "alexander": "alex sasha sandy lex xander", "anastasia": "stasia nastya ana stacy tasia", "augustin": "gus august augie", "bartholomew": "bart barty",
    "benjamin": "ben benny benji", "charlotte": "charlie lottie lotte", "christopher": "chris kit topher", "cornelius": "neil nelly corny connie", "deborah": "deb debbie debby",
    "desmond": "des desi", "dmitri": "dima mitya", "ekaterina": "katya katia kate", "elizabeth": "liz lizzie beth eliza betty betsy lisa", "francisco": "paco pancho fran cisco kiko",
    "friedrich": "fritz fred", "gabriel": "gabe gabi", "giuseppe": "beppe peppe pino joe", "guadalupe": "lupe lupita", "henrietta": "hettie hetty etta henry", "ignacio": "nacho iggy",
    "jennifer": "jenny jen jenni", "johannes": "hans jo jan hannes", "josephine": "josie jo fina", "katherine": "kate katie kathy kat kitty", "leopold": "leo poldi",
    "magdalena": "magda lena maggie", "margaret": "maggie meg peggy greta marge", "maximilian": "max maxi", "michael": "mike mick micky", "nathaniel": "nate nat nathan", "nikolai": "kolya nick niko nico",
    "oluwaseun": "seun olu", "patricia": "pat patty tricia trish patsy", "philippa": "pippa pip", "rafael": "rafa rafi raf", "rebecca": "becky becca", "richard": "rick rich dick ricky",
    "robert": "bob rob bobby robbie bert", "samuel": "sam sammy", "sebastian": "seb basti bas", "siddharth": "sid", "stephanie": "steph steffi stevie", "susanna": "sue susie suzy susi",
    "theodore": "theo ted teddy", "timothy": "tim timmy", "tobias": "toby tobi", "valentina": "val tina vale", "victoria": "vicky tori vic", "wilhelmina": "wilma mina willa", "william": "will bill billy liam",
    "yusuf": "joe", "zachary": "zach zack zac", "edouard": "ed eddy", "jurgen": "jurg", "nguyen": "",
}
LONG_FORMS: dict[str, tuple[str, ...]] = {}
for _long, _short in NICKNAMES.items():
    for _s in _short.split():
        LONG_FORMS[_s] = (*LONG_FORMS.get(_s, ()), _long)

_APOSTROPHES = re.compile(r"[’'`´‘]")
_SPLIT = re.compile(r"[^a-z0-9.]+|(?<=\.)(?=\S)|(?<=[^.])\.(?=[a-z0-9])")


def gram_key(s: str) -> int:
    """A gram as a signed 64-bit number."""
    return xxhash.xxh3_64_intdigest(s) - (1 << 63)


class Name:
    """A name as it is compared: folded tokens without titles, legal form and particles."""

    __slots__ = ("abbreviated", "full", "initials", "joined", "legal", "raw", "tokens")

    def __init__(self, raw: str) -> None:
        self.raw = raw
        text = re.sub(r"(?<=[^\W\d_])-(?=[^\W\d_])", "\x01", _APOSTROPHES.sub("", fold(raw)))
        parts = [p for p in _SPLIT.split(text.replace("\x01", "")) if p.strip(".")]
        hyphens = [p for p in _SPLIT.split(text.replace("\x01", " ")) if p.strip(".")]
        self.legal = ""
        if any(p.strip(".") in LEGAL for p in hyphens):
            parts = hyphens  # a firm's parts may be joined by hyphens
        abbreviated, tokens = [], []
        hold = ""
        firm = any(p.strip(".") in LEGAL for p in parts[1:]) or (bool(parts) and parts[0] == "the")
        for k, p in enumerate(parts):
            t = p.strip(".").replace(".", "")
            if t in LEGAL and k > 0 and len(parts) > 1:
                self.legal = LEGAL[t]
            elif (t in TITLES and len(parts) > 1 and not firm) or (firm and t in ("the", "and")):
                continue
            elif t in PARTICLES and k + 1 < len(parts):
                hold += t
            else:
                tokens.append(hold + t)
                abbreviated.append(p.endswith(".") and len(t) > 1)
                hold = ""
        self.tokens = tuple(tokens)
        self.abbreviated = tuple(abbreviated)
        self.initials = tuple(len(t) == 1 for t in tokens)
        self.full = sum(not i for i in self.initials) >= 2
        self.joined = "".join(tokens)

    def merged(self, k: int) -> Name:
        """The name with its tokens k and k + 1 written as one."""
        n = Name("")
        n.raw, n.legal, n.joined = self.raw, self.legal, self.joined
        n.tokens = (*self.tokens[:k], self.tokens[k] + self.tokens[k + 1], *self.tokens[k + 2 :])
        n.abbreviated = (*self.abbreviated[:k], self.abbreviated[k + 1], *self.abbreviated[k + 2 :])
        n.initials = tuple(len(t) == 1 for t in n.tokens)
        n.full = self.full
        return n

    def grams(self) -> dict[int, float]:
        out: dict[int, float] = {}
        for t in self.tokens:
            for form in (t, *LONG_FORMS.get(t, ())):
                padded = f"#{form}#"
                for n in (2, 3):
                    for i in range(len(padded) - n + 1):
                        b = gram_key(padded[i : i + n])
                        out[b] = out.get(b, 0.0) + 1.0
        return out


def _nick(x: str, y: str) -> bool:
    return x in LONG_FORMS.get(y, ()) or y in LONG_FORMS.get(x, ()) or bool(set(LONG_FORMS.get(x, ())) & set(LONG_FORMS.get(y, ())))


def _token(x: str, y: str, ax: bool, ay: bool, common) -> float:  # noqa: ANN001
    """Similarity of two tokens; common(t) tells in how many groups t occurs."""
    if x == y:
        return 1.0
    if len(x) == 1 or len(y) == 1:
        return 0.8 if x[0] == y[0] else 0.0
    if _nick(x, y):
        return 0.95
    if (ax and y.startswith(x)) or (ay and x.startswith(y)):
        return 0.9
    n = max(len(x), len(y))
    limit = 1 if n <= 4 else 2 if n <= 8 else 3
    d = edits(x, y, limit)
    if d > limit or _both_in_use(common(x), common(y)):
        return 0.0
    return 1 - 0.8 * d / n


def _both_in_use(m: int, n: int) -> bool:
    """Two spellings that both occur in many groups, neither much rarer than the other, are two names."""
    return min(m, n) >= 4 and min(m, n) >= 0.15 * max(m, n)


def compare(a: Name, b: Name, common) -> tuple[float, bool]:  # noqa: ANN001
    """(similarity, strong): strong when both spell out the parts that agree, or are the same short form."""
    if not a.tokens or not b.tokens:
        return (1.0, True) if a.raw.strip() == b.raw.strip() else (0.0, False)
    if a.legal and b.legal and a.legal != b.legal:
        return 0.0, False
    if len(a.tokens) > len(b.tokens):
        a, b = b, a
    if a.joined == b.joined or sorted(a.tokens) == sorted(b.tokens):
        return 1.0, True
    if len(a.tokens) == 1:
        return _single(a, b, common)
    found = _align(a, b, common)
    if not found[0] and len(a.tokens) < len(b.tokens):  # a particle typed as a part of its own
        found = max((_align(a, b.merged(k), common) for k in range(len(b.tokens) - 1)))
    return found


def _align(a: Name, b: Name, common) -> tuple[float, bool]:  # noqa: ANN001
    """The best one-to-one alignment of the tokens of a with some of b."""
    s = [[_token(x, y, ax, ay, common) for y, ay in zip(b.tokens, b.abbreviated)] for x, ax in zip(a.tokens, a.abbreviated)]
    m, n = len(a.tokens), len(b.tokens)
    # a legal form with a typing error is left among the tokens
    spare = [b.initials[j] or bool(a.legal and not b.legal and len(t) <= 6 and any(edits(t, k, 1) <= 1 for k, v in LEGAL.items() if v == a.legal)) for j, t in enumerate(b.tokens)]
    chosen = _assigned(s, a.initials, b.initials, spare)
    if chosen is None:
        return 0.0, False
    hits = [s[i][j] for i, j in chosen]
    if len(hits) < 2:
        return 0.0, False
    best = sum(hits) / len(hits)
    spelled = sum(not a.initials[i] and not b.initials[j] for i, j in chosen)
    # a middle initial that stands on both sides must agree
    loose = m - len(hits)
    if loose and loose == sum(a.initials) and any(b.initials) and spelled >= 2:
        best -= 0.2
    if not best:
        return 0.0, False
    same_form = all(i == j for i, j in zip(sorted(a.initials), sorted(b.initials))) and m == n
    return best, spelled >= 2 or (same_form and spelled == 1 and best > 0.85)


_NEVER = -1e6


def _assigned(s: list[list[float]], first: tuple[bool, ...], second: tuple[bool, ...], spare: list[bool]) -> list[tuple[int, int]] | None:
    """The pairs (i, j) of the one-to-one assignment with the greatest sum of s, more spelled-out pairs at equal sums.

    Only initials of the first side and spare tokens of the second may lack a partner; None when
    others would. Up to three tokens all ways are tried, beyond that the Hungarian method is used."""
    m, n = len(first), len(second)
    worth = [[s[i][j] + (0.0 if first[i] or second[j] else 1e-6) if s[i][j] > 0 else _NEVER for j in range(n)] for i in range(m)]
    if n <= 3:
        best: tuple[float, list[tuple[int, int]] | None] = (_NEVER / 2, None)
        for order in permutations(range(n), m):
            hit = [(i, j) for i, j in enumerate(order) if worth[i][j] > 0]
            left, right = {i for i, _ in hit}, {j for _, j in hit}
            if all(first[i] for i in range(m) if i not in left) and all(spare[j] for j in range(n) if j not in right):
                total = sum(worth[i][j] for i, j in hit)
                if total > best[0]:
                    best = (total, hit)
        return best[1]
    size = m + n  # each token may also be paired with nothing
    cost = [[_NEVER] * size for _ in range(size)]
    for i in range(m):
        cost[i][:n] = worth[i]
        for j in range(n, size):
            cost[i][j] = 0.0 if first[i] else _NEVER
    for i in range(m, size):
        for j in range(n):
            cost[i][j] = 0.0 if spare[j] else _NEVER
        for j in range(n, size):
            cost[i][j] = 0.0
    match = _hungarian([[-c for c in row] for row in cost])
    if sum(cost[i][j] for i, j in enumerate(match)) < _NEVER / 2:
        return None
    return [(i, j) for i, j in enumerate(match) if i < m and j < n]


def _hungarian(cost: list[list[float]]) -> list[int]:
    """The column of each row in the cheapest assignment of a square matrix, by shortest augmenting paths."""
    n = len(cost)
    u, v, owner, way = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for row in range(1, n + 1):
        owner[0], at = row, 0
        least, used = [float("inf")] * (n + 1), [False] * (n + 1)
        while owner[at]:
            used[at], i, step, nxt = True, owner[at], float("inf"), 0
            for j in range(1, n + 1):
                if not used[j]:
                    c = cost[i - 1][j - 1] - u[i] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, at
                    if least[j] < step:
                        step, nxt = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[owner[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            at = nxt
        while at:
            owner[at], at = owner[way[at]], way[at]
    out = [0] * n
    for j in range(1, n + 1):
        out[owner[j] - 1] = j - 1
    return out


def _single(a: Name, b: Name, common) -> tuple[float, bool]:  # noqa: ANN001
    t = a.tokens[0]
    if len(b.tokens) == 1:
        u = b.tokens[0]
        if _nick(t, u):
            return 0.7, False
        n = max(len(t), len(u))
        d = edits(t, u, 2)
        ok = n >= 6 and d <= (1 if n < 10 else 2) and not _both_in_use(common(t), common(u))
        return (1 - d / n, True) if ok else (0.0, False)
    words = [x for x, i in zip(b.tokens, b.initials) if not i]
    if not words:
        return 0.0, False
    if len(words) == 1 and any(b.initials):  # an initial and one word
        letters = [x for x, i in zip(b.tokens, b.initials) if i]
        if any(t in (x + words[0], words[0] + x) for x in letters):
            return 0.9, True
        return (0.6, False) if t == words[0] or _nick(t, words[0]) else (0.0, False)
    best = 0.0
    for x in words:
        for y in words:
            if x is not y:
                if t == x + y:
                    return 0.95, True
                if t in (x[0] + y, x + y[0]):
                    best = max(best, 0.85)
                elif len(t) > 7 and t[0] == x[0] and edits(t[1:], y, 1) <= 1:
                    best = max(best, 0.75)
                elif len(t) > 9 and edits(t, x + y, 2) <= 2:
                    return 0.9, True
    for x in words:
        s = _token(t, x, False, False, common) if len(t) > 1 else 0.0
        if s >= 0.95:
            best = max(best, 0.7 * s)
        elif s > 0 and len(t) >= 5:
            best = max(best, 0.5 * s)
    return best, False


def average_linkage(ids: list[int], pairs: list[tuple[int, int, float]], threshold: float) -> dict[int, int]:
    """id -> cluster, its smallest id: clusters that are each other's closest join while their average similarity is at least the threshold.

    Pairs not listed count 0; of equally close ones the one with the smallest id is the closest."""
    label = {i: i for i in ids}
    size = dict.fromkeys(ids, 1)
    sums: dict[int, dict[int, float]] = {i: {} for i in ids}
    for i, j, s in pairs:
        sums[i][j] = sums[j][i] = s
    fresh = set(ids)
    closest: dict[int, int] = {}
    while fresh:
        for i in fresh:
            best = min(((-round(s / (size[i] * size[j]), 9), j) for j, s in sums[i].items()), default=None)
            closest.pop(i, None)
            if best is not None and -best[0] >= threshold:
                closest[i] = best[1]
        joined = [(i, j) for i, j in closest.items() if i < j and closest.get(j) == i]
        fresh = set()
        for i, j in joined:
            for k, s in sums.pop(j).items():
                del sums[k][j]
                if k != i:
                    sums[i][k] = sums[k][i] = sums[i].get(k, 0.0) + s
            size[i] += size.pop(j)
            label[j] = i
            closest.pop(j, None)
            fresh.add(i)
        # who lost or neighbours a changed cluster looks again
        fresh |= {k for i in list(fresh) for k in sums[i]} | {k for k, c in closest.items() if c not in size}
    for i in sorted(ids):
        at = i
        while label[at] != at:
            at = label[at]
        label[i] = at
    return label


def _linked_by_rounds(names: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """average_linkage as joins, for components of any size: (nid, cluster) from (nid) and (a, b, score)."""
    scratch = Scratch()
    label = scratch.cut(names.select("nid", F.col("nid").alias("cluster")), "linkage")
    while True:
        size = label.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
        ends = pairs.join(label.select(F.col("nid").alias("a"), F.col("cluster").alias("i")), "a").join(label.select(F.col("nid").alias("b"), F.col("cluster").alias("j")), "b").where("i <> j")
        sums = ends.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "score").groupBy("i", "j").agg(F.sum("score").alias("s"))
        mean = sums.join(size.select(F.col("cluster").alias("i"), F.col("n").alias("ni")), "i").join(size.select(F.col("cluster").alias("j"), F.col("n").alias("nj")), "j")
        mean = mean.select("i", "j", F.round(F.col("s") / (F.col("ni") * F.col("nj")), 9).alias("m")).where(F.col("m") >= threshold)
        both = mean.unionByName(mean.select(F.col("j").alias("i"), F.col("i").alias("j"), "m"))
        best = scratch.cut(both.groupBy("i").agg(F.min_by("j", F.struct(-F.col("m"), F.col("j"))).alias("j")), "closest")
        mutual = best.join(best.select(F.col("i").alias("j"), F.col("j").alias("i")), ["i", "j"]).where("i < j")
        mutual = scratch.cut(mutual.select(F.col("j").alias("cluster"), F.col("i").alias("into")), "joined")
        if mutual.isEmpty():
            out = cut(label, "linkage")
            scratch.clear()
            return out
        label = scratch.cut(label.join(mutual, "cluster", "left").select("nid", F.coalesce("into", "cluster").alias("cluster")), "linkage")


def _components(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """(nid, comp): the smallest nid reachable over the pairs."""
    scratch = Scratch()
    edges = scratch.cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    # only names with a pair take part in the rounds
    labels = scratch.cut(edges.select(F.col("a").alias("nid")).distinct().withColumn("comp", F.col("nid")), "labels")
    while True:
        low = edges.join(labels.select(F.col("nid").alias("b"), "comp"), "b").groupBy(F.col("a").alias("nid")).agg(F.min("comp").alias("low"))
        moved = labels.join(low, "nid", "left").select("nid", F.least("comp", "low").alias("comp"), F.col("comp").alias("was"))
        # follow the label's own label, so that chains shorten by half
        ahead = moved.select(F.col("nid").alias("comp"), F.col("comp").alias("comp2"))
        moved = scratch.cut(moved.join(ahead, "comp").select("nid", F.col("comp2").alias("comp"), "was"), "labels")
        labels = moved.select("nid", "comp")
        if moved.where("comp <> was").isEmpty():
            out = cut(names.select("nid").join(labels, "nid", "left").select("nid", F.coalesce("comp", "nid").alias("comp")), "components")
            scratch.clear()
            return out


def _of_names(names: DataFrame, make, schema: str, columns: list[str]) -> DataFrame:  # noqa: ANN001
    """The rows that make(row) gives for each row of names."""
    given = names.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([x for r in zip(*(b[c] for c in given)) for x in make(*r)], columns=columns)

    return names.mapInPandas(run, schema)


def _unit(grams: dict[int, float], weight, often) -> list[tuple[int, float]]:  # noqa: ANN001
    """(gram, share) of a unit vector, rarest grams first."""
    v = [(k, c * weight(k)) for k, c in grams.items()]
    norm = sum(x * x for _, x in v) ** 0.5
    return sorted(((k, x / norm) for k, x in v), key=lambda p: (often(p[0]), p[0])) if norm else []


def link_names(
    pairs_of: DataFrame, group: str = "project", name: str = "name", cosine: float = 0.2, strong: float = 0.7, linkage: float = 0.4, weak: float = 0.3,
    block: int = 1000, most_grams: int = 1_000_000, component: int = 2000,
) -> DataFrame:
    """(group, name, entity) for the distinct names of each group; entity numbers are unique over all groups."""
    spark = pairs_of.sparkSession
    scratch = Scratch()
    names = pairs_of.select(F.col(group).alias("grp"), F.col(name).alias("name")).where(F.col("grp").isNotNull() & (F.length(F.trim("name")) > 0)).distinct()
    names = cut(names.withColumn("nid", F.monotonically_increasing_id()), "names")
    total = max(names.count(), 1)

    # how many groups use each token; every name gets those of its own tokens
    tokens = scratch.cut(_of_names(names.select("grp", "name", "nid"), lambda g, s, i: [(g, i, k, t) for k, t in enumerate(Name(s).tokens)], "grp string, nid long, at int, token string", ["grp", "nid", "at", "token"]), "tokens")
    used = tokens.select("grp", "token").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    uses = tokens.join(used, "token").groupBy("nid").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "n"))), lambda x: x["n"].cast("int")).alias("uses"))
    told = names.join(uses, "nid", "left").select("nid", "grp", "name", F.coalesce("uses", F.array().cast("array<int>")).alias("uses"))

    grams = scratch.cut(_of_names(names.select("name", "nid"), lambda s, i: [(i, k, c) for k, c in Name(s).grams().items()], "nid long, gram long, c double", ["nid", "gram", "c"]), "grams")
    often = scratch.cut(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "often")
    shared = None
    if often.count() <= most_grams:
        rows = often.toPandas().sort_values("gram")
        shared = spark.sparkContext.broadcast((rows["gram"].to_numpy(), rows["n"].to_numpy()))

    def lookups():  # noqa: ANN202
        keys, counts = shared.value
        at = dict(zip(keys.tolist(), counts.tolist()))
        return (lambda k: np.log(1 + total / at[k])), (lambda k: at[k])

    share = F.col("c") * F.log(1 + total / F.col("n"))
    whole = W.partitionBy("nid")
    rarest = W.partitionBy("nid").orderBy("n", "gram").rowsBetween(W.unboundedPreceding, -1)
    weighed = grams.join(often, "gram").select("nid", "gram", "n", share.alias("x")).withColumn("x", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(whole)))
    gone = F.coalesce(F.sum(F.col("x") * F.col("x")).over(rarest), F.lit(0.0))
    prefix = weighed.withColumn("gone", gone).where(1 - F.col("gone") >= cosine * cosine - 1e-9).select("nid", "gram")
    keyed = scratch.cut(prefix.join(names.select("nid", "grp"), "nid").select("grp", "gram", "nid"), "prefixes")
    # a gram of a hot group is joined in blocks: each name stands in one block on the left and in all on the right
    many = keyed.groupBy("grp", "gram").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).where("blocks > 1")
    parts = keyed.join(many, ["grp", "gram"], "left").select("grp", "gram", "nid", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    left = parts.select("grp", "gram", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int").alias("part"), F.col("nid").alias("a"))
    right = parts.select("grp", "gram", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.col("nid").alias("b"))
    candidates = left.join(right, ["grp", "gram", "part"]).where("a < b").select("a", "b").distinct()
    side = lambda c: told.select(F.col("nid").alias(c), F.col("name").alias(f"name_{c}"), F.col("uses").alias(f"uses_{c}"))
    candidates = candidates.join(side("a"), "a").join(side("b"), "b")
    if shared is None:
        vectors = scratch.cut(weighed.groupBy("nid").agg(F.map_from_entries(F.collect_list(F.struct("gram", "x"))).alias("v")), "vectors")
        candidates = candidates.join(vectors.select(F.col("nid").alias("a"), F.col("v").alias("v_a")), "a").join(vectors.select(F.col("nid").alias("b"), F.col("v").alias("v_b")), "b")

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight = often_ = None
        if shared is not None:
            weight, often_ = lookups()
        memo: dict[str, tuple[Name, dict[int, float], dict[str, int]]] = {}

        def of(s: str, uses: np.ndarray) -> tuple[Name, dict[int, float], dict[str, int]]:
            if s not in memo:
                if len(memo) > 50_000:
                    memo.clear()
                n = Name(s)
                memo[s] = (n, dict(_unit(n.grams(), weight, often_)) if weight else {}, dict(zip(n.tokens, map(int, uses))))
            return memo[s]

        for b in batches:
            rows = []
            given = zip(b["v_a"], b["v_b"]) if shared is None else [(None, None)] * len(b)
            for i, j, s, t, x, y, (u, v) in zip(b["a"], b["b"], b["name_a"], b["name_b"], b["uses_a"], b["uses_b"], given):
                (m, p, known_a), (n, q, known_b) = of(s, x), of(t, y)
                u, v = (p, q) if u is None else (dict(u), dict(v))
                if len(v) < len(u):
                    u, v = v, u
                c = sum(w * v.get(k, 0.0) for k, w in u.items())
                if c >= cosine:
                    score, sure = compare(m, n, lambda t, k=known_a, l=known_b: k.get(t) or l.get(t, 0))
                    if score > 0:
                        rows.append((i, j, c, score, sure))
            yield pd.DataFrame(rows, columns=["a", "b", "cosine", "score", "sure"])

    pairs = cut(candidates.mapInPandas(scored, "a long, b long, cosine double, score double, sure boolean"), "pairs")
    scratch.clear()
    comps = _components(pairs.where(F.col("sure") & (F.col("score") >= strong)), names)
    inside = pairs.join(comps.select(F.col("nid").alias("a"), "comp"), "a").join(comps.select(F.col("nid").alias("b"), F.col("comp").alias("comp_b")), "b").where("comp = comp_b").select("comp", "a", "b", "score")
    inside = scratch.cut(inside, "inside")
    size = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
    large = scratch.cut(size.where(F.col("n") > component).select("comp"), "large")
    small = inside.join(large, "comp", "left_anti").groupBy("comp").agg(F.collect_list(F.struct("a", "b", "score")).alias("p"))

    def clustered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p in b["p"]:
                listed = sorted((x["a"], x["b"], x["score"]) for x in p)
                ids = sorted({i for x in listed for i in x[:2]})
                rows += average_linkage(ids, listed, linkage).items()
            yield pd.DataFrame(rows, columns=["nid", "cluster"])

    done = small.mapInPandas(clustered, "nid long, cluster long")
    if not large.isEmpty():
        done = done.unionByName(_linked_by_rounds(comps.join(large, "comp", "left_semi"), inside.join(large, "comp", "left_semi"), linkage))
    done = scratch.cut(done, "clustered")
    full = _of_names(names.select("name", "nid"), lambda s, i: [(i, Name(s).full)], "nid long, is_full boolean", ["nid", "is_full"])
    clusters = cut(full.join(done, "nid", "left").select("nid", F.coalesce("cluster", "nid").alias("cluster"), "is_full"), "clusters")
    scratch.clear()
    about = clusters.groupBy("cluster").agg(F.max("is_full").alias("is_full"), F.count(F.lit(1)).alias("size"))
    both = pairs.select("a", "b", "score").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    ends = both.join(clusters.select(F.col("nid").alias("a"), F.col("cluster").alias("short")), "a").join(clusters.select(F.col("nid").alias("b"), F.col("cluster").alias("long")), "b")
    sums = ends.where("short <> long").groupBy("short", "long").agg(F.sum("score").alias("sum"))
    sized = sums.join(about.where(~F.col("is_full")).select(F.col("cluster").alias("short"), F.col("size").alias("n_short")), "short")
    sized = sized.join(about.where("is_full").select(F.col("cluster").alias("long"), F.col("size").alias("n_long")), "long").withColumn("mean", F.col("sum") / (F.col("n_short") * F.col("n_long")))
    joined = sized.where(F.col("mean") >= weak).groupBy("short").agg(F.min_by("long", F.struct((-F.round("mean", 9)).alias("m"), (-F.col("n_long")).alias("n"), "long")).alias("long"))
    final = clusters.join(joined.withColumnRenamed("short", "cluster"), "cluster", "left").select("nid", F.coalesce("long", "cluster").alias("entity"))
    return names.join(final, "nid").select(F.col("grp").alias(group), F.col("name").alias(name), "entity")


def variant_pairs(linked: DataFrame, group: str = "project", name: str = "name") -> DataFrame:
    """(group, name_a, name_b): every pair of different strings of one entity, name_a < name_b."""
    a = linked.select(group, "entity", F.col(name).alias("name_a"))
    b = linked.select("entity", F.col(name).alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select(group, "name_a", "name_b")
