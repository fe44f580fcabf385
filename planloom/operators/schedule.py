"""Critical path over a dependency graph, with circles laid out one task after the other.

Tasks with one predecessor hang from it, so the graph falls into trees whose heads have none or
several. Within trees everything is found by pointer doubling, in log2(depth) rounds; only between
heads do frontiers advance, a round settling every head whose predecessors are settled. Each
round's rows are written once, no component is gathered, and what a result no longer reads is deleted.

Defined results
- tasks without a duration take 0; negative ones 0. A task in several rows: its last row.
- predecessors that are no task are dropped. Repeated dependencies count once; a dependency on itself is a circle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planloom.session import Rounds, Scratch, cut, drop_cut


class CircularDependency(ValueError):
    """The graph has a circle, so a strict schedule doesn't exist."""


def graph(tasks: DataFrame, deps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, dur, ordinal) and (pred, id) cleaned."""
    last = tasks.where(F.col("id").isNotNull()).groupBy("id").agg(F.max_by("dur", "ordinal").alias("dur"), F.max("ordinal").alias("ordinal"))
    nodes = cut(last.select("id", F.greatest(F.coalesce(F.col("dur").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("dur"), "ordinal"), "nodes")
    ids = nodes.select("id")
    edges = deps.select("pred", "id").distinct().join(ids, "id", "left_semi").join(ids.withColumnRenamed("id", "pred"), "pred", "left_semi")
    return nodes, cut(edges, "edges")


class _Trees:
    """A graph as trees of tasks with one predecessor each.

    chain: (id, dur, head, upto), upto being the durations from the head to the task inclusive; linked:
    (id, dur, head) with the direct predecessor as head, null for heads; caught: (id, up) of the tasks
    whose predecessors run into a circle that nothing else enters, or None; arcs: (a, b, ha, upto), the
    dependencies that end at heads."""

    def __init__(self, nodes: DataFrame, edges: DataFrame) -> None:
        self.nodes, self.scratch = nodes, Scratch()
        cut_ = self.scratch.cut
        single = edges.groupBy("id").agg(F.max("pred").alias("head"), F.count(F.lit(1)).alias("n")).where("n = 1")
        self.linked = cut_(nodes.join(single.select("id", "head"), "id", "left").select("id", "dur", "head"), "links")
        done = Rounds(nodes.sparkSession, "trees")
        done.add(self.linked.where(F.col("head").isNull()).select("id", F.col("id").alias("head"), F.col("dur").alias("upto")))
        waiting = self.linked.where(F.col("head").isNotNull()).select("id", "head", F.col("dur").alias("upto"))
        left = waiting.count()
        while left:
            known = done.all().withColumn("fixed", F.lit(True)).unionByName(waiting.withColumn("fixed", F.lit(False)))
            ahead = known.select(F.col("id").alias("head"), F.col("head").alias("head2"), F.col("upto").alias("upto2"), "fixed")
            moved = cut_(waiting.join(ahead, "head").select("id", F.col("head2").alias("head"), (F.col("upto") + F.col("upto2")).alias("upto"), "fixed"), "links")
            done.add(moved.where("fixed").drop("fixed"))
            waiting = moved.where("not fixed").drop("fixed")
            now = waiting.count()
            if now == left:  # all that is left runs into closed circles
                break
            left = now
        self.chain = cut_(done.all().join(nodes.select("id", "dur"), "id"), "chain")
        done.drop()
        self.caught = waiting.select("id", F.col("head").alias("up")) if left else None
        heads = self.linked.where(F.col("head").isNull()).select(F.col("id").alias("b"))
        of_a = self.chain.select(F.col("id").alias("a"), F.col("head").alias("ha"), "upto")
        self.arcs = cut_(edges.select(F.col("pred").alias("a"), F.col("id").alias("b")).join(heads, "b").join(of_a, "a", "left"), "arcs")

    def starts(self) -> DataFrame:
        """(id, value): when the heads that are on or behind no circle can start."""
        base = self.chain.where("id = head").select("id", F.lit(0.0).alias("base"))
        return _fronts(base, self.arcs.select(F.coalesce("ha", "a").alias("a"), "b", F.coalesce("upto", F.lit(0.0)).alias("w")))

    def tails(self) -> DataFrame:
        """(id, value): the longest sum of durations from a head on, of heads ahead of no circle."""
        base = self.chain.groupBy(F.col("head").alias("id")).agg(F.max("upto").alias("base"))
        return _fronts(base, self.arcs.where(F.col("ha").isNotNull()).select(F.col("b").alias("a"), F.col("ha").alias("b"), F.col("upto").alias("w")))

    def whole_tails(self, tails: DataFrame) -> DataFrame:
        """(id, tail) of every task of a graph without circles: its subtree's farthest end, trees beyond included."""
        beyond = self.arcs.join(tails.select(F.col("id").alias("b"), "value"), "b").groupBy(F.col("a").alias("id")).agg(F.max("value").alias("ext"))
        far = self.scratch.cut(self.chain.join(beyond, "id", "left").select("id", (F.col("upto") + F.coalesce("ext", F.lit(0.0))).alias("m")), "far")
        climbing = self.scratch.cut(self.linked.where(F.col("head").isNotNull()).select("id", F.col("head").alias("up")).join(far, "id"), "climbing")
        gains = Rounds(self.nodes.sparkSession, "far")
        gains.add(far)
        while not climbing.isEmpty():
            gain = gains.add(climbing.groupBy(F.col("up").alias("id")).agg(F.max("m").alias("m")))
            further = climbing.join(climbing.select(F.col("id").alias("up"), F.col("up").alias("up2")), "up").select("id", F.col("up2").alias("up"), "m")
            climbing = self.scratch.cut(further.join(gain.withColumnRenamed("m", "g"), "id", "left").select("id", "up", F.greatest("m", F.coalesce("g", "m")).alias("m")), "climbing")
        most = gains.all().groupBy("id").agg(F.max("m").alias("m"))
        out = cut(self.chain.join(most, "id").select("id", (F.col("dur") - F.col("upto") + F.col("m")).alias("tail")), "tails")
        gains.drop()
        return out


def _fronts(base: DataFrame, arcs: DataFrame) -> DataFrame:
    """(id, value): the greatest of a head's base and value(a) + w over the arcs a -> b = id; heads on or behind a circle are missing."""
    scratch, fronts = Scratch(), Rounds(base.sparkSession, "fronts")
    arcs = scratch.cut(arcs.groupBy("a", "b").agg(F.max("w").alias("w")), "arcs")
    need = arcs.groupBy(F.col("b").alias("id")).agg(F.count(F.lit(1)).alias("need"))
    todo = scratch.cut(base.join(need, "id"), "need")
    frontier = fronts.add(base.join(need.select("id"), "id", "left_anti").select("id", F.col("base").alias("value")))
    waiting = None
    while not frontier.isEmpty():
        step = frontier.join(arcs, F.col("id") == F.col("a")).groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("value") + F.col("w")).alias("top"))
        merged = step if waiting is None else step.unionByName(waiting).groupBy("b").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
        merged = scratch.cut(merged, "wait")
        ready = merged.join(todo, F.col("b") == F.col("id")).where(F.col("n") == F.col("need"))
        frontier = fronts.add(ready.select("id", F.greatest("base", "top").alias("value")))
        waiting = merged.join(frontier.select(F.col("id").alias("b")), "b", "left_anti")
    out = cut(fronts.all(), "fronts")
    fronts.drop()
    scratch.clear()
    return out


def critical_path(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """(id, es, ef, ls, lf, duration, slack, critical); raises CircularDependency."""
    return _laid_out(*graph(tasks, deps))


def _laid_out(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    trees = _Trees(nodes, edges)
    starts = None if trees.caught is not None else trees.starts()
    if starts is None or starts.count() < trees.chain.where("id = head").count():
        trees.scratch.clear()
        raise CircularDependency("tasks depend on each other in a circle")
    tail = trees.whole_tails(trees.tails())
    ahead = cut(trees.chain.join(starts.select(F.col("id").alias("head"), "value"), "head").select("id", "dur", (F.col("value") + F.col("upto")).alias("end")), "ends")
    trees.scratch.clear()
    drop_cut(starts)
    whole = ahead.agg(F.max("end").alias("total"))
    j = ahead.join(tail, "id").join(F.broadcast(whole))
    ls = F.col("total") - F.col("tail")
    out = j.select("id", (F.col("end") - F.col("dur")).alias("es"), F.col("end").alias("ef"), ls.alias("ls"), (ls + F.col("dur")).alias("lf"), F.col("dur").alias("duration"))
    slack = F.col("ls") - F.col("es")
    return out.withColumns({"slack": slack, "critical": F.abs(slack) < 1e-9})


def _closed(caught: DataFrame, linked: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, comp): the closed circles among tasks with one predecessor each, named by their largest id.

    Images under more and more steps shrink to the circles; the largest id spreads round them by doubling."""
    images = -1
    while True:
        on = scratch.cut(caught.select("up").distinct(), "images")
        now = on.count()
        if now == images:
            break
        images = now
        caught = scratch.cut(caught.join(caught.select(F.col("id").alias("up"), F.col("up").alias("up2")), "up").select("id", F.col("up2").alias("up")), "caught")
    ring = on.select(F.col("up").alias("id")).join(linked.select("id", "head"), "id").select("id", F.col("head").alias("next"), F.col("id").alias("comp"))
    while True:
        ahead = ring.select(F.col("id").alias("next"), F.col("next").alias("next2"), F.col("comp").alias("comp2"))
        moved = scratch.cut(ring.join(ahead, "next").select("id", F.col("next2").alias("next"), F.greatest("comp", "comp2").alias("comp"), (F.col("comp2") > F.col("comp")).alias("rose")), "ring")
        ring = moved.drop("rose")
        if moved.where("rose").isEmpty():
            return ring.select("id", "comp")


def circles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, comp): each task's strongly connected component, named by its largest id.

    Closed circles of tasks with one predecessor come first. Of the others, trees whose heads peel off
    from either end hold no circle. In the rest the largest id that reaches a task colours it; a
    colour's component is what reaches its largest id within the colour."""
    trees = _Trees(nodes, edges)
    scratch, found = Scratch(), Rounds(nodes.sparkSession, "circles")
    heads = trees.chain.where("id = head").select("id")
    open_heads = heads.join(trees.starts(), "id", "left_anti").join(trees.tails(), "id", "left_anti").select(F.col("id").alias("head"))
    core = scratch.cut(trees.chain.join(open_heads, "head").select("id"), "core")
    closed = None
    if trees.caught is not None:
        closed = found.add(_closed(trees.caught, trees.linked, scratch))
    alone = nodes.select("id").join(core, "id", "left_anti")
    found.add((alone if closed is None else alone.join(closed.select("id"), "id", "left_anti")).select("id", F.col("id").alias("comp")))
    trees.scratch.clear()
    while not core.isEmpty():
        inner = scratch.cut(edges.join(core, "id", "left_semi").join(core.withColumnRenamed("id", "pred"), "pred", "left_semi"), "inner")
        # what nothing leads to, or what leads nowhere, is on no circle
        both = inner.select("id").intersect(inner.select(F.col("pred").alias("id")))
        kept = scratch.cut(core.join(both, "id", "left_semi"), "core")
        lost = core.join(kept, "id", "left_anti")
        if not lost.isEmpty():
            found.add(lost.select("id", F.col("id").alias("comp")))
            core = kept
            continue
        colour = scratch.cut(core.select("id", F.col("id").alias("c")), "colour")
        while True:
            top = inner.join(colour.select(F.col("id").alias("pred"), "c"), "pred").groupBy("id").agg(F.max("c").alias("c2"))
            moved = scratch.cut(colour.join(top, "id", "left").select("id", F.greatest("c", F.coalesce("c2", "c")).alias("c"), F.col("c").alias("was")), "colour")
            colour = moved.drop("was")
            if moved.where("c <> was").isEmpty():
                break
        hit = scratch.cut(colour.where("id = c"), "hit")
        front = hit
        while not front.isEmpty():
            reach = front.join(inner, "id").select(F.col("pred").alias("id"), "c").distinct().join(colour, ["id", "c"], "left_semi").join(hit, "id", "left_anti")
            front = scratch.cut(reach, "front")
            hit = scratch.cut(hit.unionByName(front), "hit")
        found.add(hit.select("id", F.col("c").alias("comp")))
        core = scratch.cut(core.join(hit.select("id"), "id", "left_anti"), "core")
    scratch.clear()
    return found.all()


def relaxed_path(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """critical_path for any graph: a circle is one block of summed duration whose tasks follow one
    another in row order. cycle_group names the block's tasks in order, null outside circles."""
    nodes, edges = graph(tasks, deps)
    comp = circles(nodes, edges)
    j = cut(nodes.join(comp, "id"), "members")
    blocks = j.groupBy("comp").agg(F.sum("dur").alias("dur"), F.min("ordinal").alias("ordinal"), F.count(F.lit(1)).alias("n"))
    b = blocks.select(F.col("comp").alias("id"), "dur", "ordinal")
    up, down = comp.select(F.col("id").alias("pred"), F.col("comp").alias("cp")), comp.select("id", F.col("comp").alias("ci"))
    between = edges.join(up, "pred").join(down, "id").where("cp <> ci").select(F.col("cp").alias("pred"), F.col("ci").alias("id")).distinct()
    between = cut(between, "between")
    laid = _laid_out(b.select("id", "dur"), between)
    order = W.partitionBy("comp").orderBy("ordinal", "id").rowsBetween(W.unboundedPreceding, -1)
    at = j.withColumn("shift", F.coalesce(F.sum("dur").over(order), F.lit(0.0)))
    loops = edges.where("pred = id").select("id", F.lit(True).alias("self"))
    rows = at.join(laid.select(F.col("id").alias("comp"), "es", "slack"), "comp").join(blocks.select("comp", "n"), "comp").join(loops, "id", "left")
    # only members of circles are gathered, one circle to a value of the result
    named = rows.where("n > 1").groupBy("comp").agg(F.concat_ws(" -> ", F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "id"))), lambda x: x["id"].cast("string"))).alias("cycle_group"))
    es = F.col("es") + F.col("shift")
    out = rows.join(named, "comp", "left").select(
        "id", es.alias("es"), (es + F.col("dur")).alias("ef"), (es + F.col("slack")).alias("ls"), (es + F.col("slack") + F.col("dur")).alias("lf"), F.col("dur").alias("duration"), "slack",
        (F.abs("slack") < 1e-9).alias("critical"), F.when(F.col("n") > 1, F.col("cycle_group")).when(F.col("self"), F.col("id").cast("string")).alias("cycle_group"),
    )
    return out


def schedule(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """The strict schedule, or the relaxed one where tasks depend on each other in a circle."""
    try:
        return critical_path(tasks, deps).withColumn("cycle_group", F.lit(None).cast("string"))
    except CircularDependency:
        return relaxed_path(tasks, deps)


def durations(effort: str, opt: str, most: str, pess: str) -> list:
    """The three-point estimate, or 0.8, 1 and 1.25 times the effort (missing: 1) where a part is missing."""
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.col(c).cast("double"))
    e = F.coalesce(number(effort), F.lit(1.0))
    whole = number(opt).isNotNull() & number(most).isNotNull() & number(pess).isNotNull()
    return [F.when(whole, number(c)).otherwise(e * f).alias(n) for c, f, n in ((opt, 0.8, "opt"), (most, 1.0, "most"), (pess, 1.25, "pess"))]


def with_estimates(tasks: DataFrame, deps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The schedule by the likeliest durations, and its pert_samples.

    tasks has id, ordinal, effort, opt_duration, most_duration, pess_duration; a task in several rows: its last row."""
    t = tasks.where(F.col("id").isNotNull()).select("id", "ordinal", *durations("effort", "opt_duration", "most_duration", "pess_duration"))
    last = cut(t.groupBy("id").agg(F.max_by(F.struct("opt", "most", "pess"), "ordinal").alias("e"), F.max("ordinal").alias("ordinal")).select("id", "ordinal", "e.*"), "estimates")
    plan = schedule(last.select("id", F.col("most").alias("dur"), "ordinal"), deps)
    return plan, pert_samples(last, plan)


def pert_samples(tasks: DataFrame, critical: DataFrame, trials: int = 2000, seed: int = 42) -> DataFrame:
    """(trial, duration): Beta-PERT draws summed over critical tasks, at least the longest single task.

    tasks has id, opt, most, pess. Draws depend on the task's id and the seed alone, so partitioning
    changes nothing; each task batch is reduced to `trials` partial sums before the shuffle.
    No task is left out: where pess is not over opt, or one of them is missing, each draw is `most`
    (missing: 1); where most lies outside opt and pess, the range is widened to it."""
    tasks = tasks.withColumn("most", F.coalesce(F.nanvl(F.col("most").cast("double"), F.lit(1.0)), F.lit(1.0)))
    t = tasks.join(critical.where("critical").select("id", F.lit(True).alias("crit")), "id", "left").select(F.col("id").cast("string").alias("id"), "opt", "most", "pess", F.coalesce("crit", F.lit(False)).alias("crit"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, most = np.zeros(trials), np.zeros(trials)
        for b in batches:
            for i, a, m, z, crit in zip(b["id"], b["opt"], b["most"], b["pess"], b["crit"]):
                if z > a:
                    a, z = min(a, m), max(z, m)
                    rng = np.random.default_rng([seed, xxhash.xxh64_intdigest(i)])
                    x = a + (z - a) * rng.beta(1 + 4 * (m - a) / (z - a), 1 + 4 * (z - m) / (z - a), trials)
                else:
                    x = np.full(trials, m)
                np.maximum(most, x, out=most)
                if crit:
                    total += x
        yield pd.DataFrame({"trial": np.arange(trials), "s": total, "m": most})

    part = t.mapInPandas(draw, "trial int, s double, m double")
    return part.groupBy("trial").agg(F.greatest(F.sum("s"), F.max("m")).alias("duration"))
