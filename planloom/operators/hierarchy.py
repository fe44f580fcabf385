"""Parent-child links to full hierarchies by heavy-path decomposition, with cycles set apart.

1. Each node gets a number and its parent's number. Pointer doubling brings, in round k, the
   ancestor 2^k steps up; a node's subtree size grows by the sizes of the nodes whose 2^k-th
   ancestor it is. The rounds end when no node drops out any more: what is left runs into a circle.
2. Among those, the images under more and more steps shrink to the circles themselves; the smallest
   name of each circle spreads round it by doubling.
3. In the forest, each node's child with the largest subtree continues its chain; all others begin
   one. A root path crosses at most log2(n) chains, so chains are labelled from the roots down in
   that many rounds: depth, root, number in depth-first order and, if wanted, the path so far.
4. A node's path is its chain's path so far and the chain's first part; its descendants are the
   numbers `first` to `first + n_descendants` in depth-first order.

Scale: every round is joins and partial aggregations on one node number, cut by a written table;
no round handles a group in one task, and the rounds grow with the logarithm of the depth. Children
of one parent are numbered by two-level running sums, so a parent of a third of all rows is spread.

Defined results
- null or blank nodes: no row. A node in several rows takes the reference of its earliest row that has one.
- references are read without case, blanks, quotes, brackets and stray delimiters around them; unknown,
  null and empty ones count as none. Nodes that differ only so are told apart; a reference to them means the smallest.
- on or into a circle (a reference to itself is a circle): depth -1, root the smallest node of the
  circle, no path, no numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planloom.session import Rounds, Scratch, cut, drop_cut

_STRAY = r"[\s\p{Z}\"'“”„‘’`´«»\[\](){}<>,;|/\\.:&+*#-]"
_SALT = 64


def reference_key(c: Column) -> Column:
    """A reference or node as it is compared: lower case, nothing stray around it."""
    return F.lower(F.regexp_replace(c, rf"^{_STRAY}+|{_STRAY}+$", ""))


def _nodes(df: DataFrame, node: str, ref: str, order: str) -> DataFrame:
    """(v, name, parent): numbered nodes with the number of their parent or null."""
    key = reference_key(F.col(ref))
    said = F.when(key != "", key)
    named = (
        df.where(F.length(F.trim(F.col(node))) > 0).select(F.col(node).alias("name"), said.alias("ref"), F.col(order).alias("o"))
        .groupBy("name").agg(F.min_by("ref", F.when(F.col("ref").isNotNull(), F.struct("o", "ref"))).alias("ref"))
    )
    numbered = cut(named.withColumn("v", F.monotonically_increasing_id()), "nodes")
    keys = numbered.groupBy(reference_key(F.col("name")).alias("ref")).agg(F.min_by("v", "name").alias("parent"))
    told = numbered.where(F.col("ref").isNotNull()).join(keys, "ref", "left").select("v", "name", "parent")
    return cut(told.unionByName(numbered.where(F.col("ref").isNull()).select("v", "name", F.lit(None).cast("long").alias("parent"))), "edges")


def _sizes(nodes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """(v, size) of all nodes; (v, up) of those that run into a circle, up being 2^k steps on.

    Only nodes that still climb are carried on; what the others gain is written once a round and summed at the end."""
    climbing = scratch.cut(nodes.where(F.col("parent").isNotNull()).select("v", F.col("parent").alias("up"), F.lit(1).cast("long").alias("size")), "climbing")
    gains = Rounds(nodes.sparkSession, "gains")
    gains.add(nodes.select("v", F.lit(1).cast("long").alias("gain")))
    left = climbing.count()
    while left:
        gain = gains.add(climbing.groupBy(F.col("up").alias("v")).agg(F.sum("size").alias("gain")))
        further = climbing.join(climbing.select(F.col("v").alias("up"), F.col("up").alias("up2")), "up").select("v", F.col("up2").alias("up"), "size")
        climbing = scratch.cut(further.join(gain, "v", "left").select("v", "up", (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size")), "climbing")
        now = climbing.count()
        if now == left:
            break
        left = now
    return gains.all().groupBy("v").agg(F.sum("gain").alias("size")), (climbing.select("v", "up") if left else None)


def _circles(nodes: DataFrame, caught: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, root): for nodes on or into a circle the smallest name on it."""
    images = caught.select("up").distinct().count()
    while True:
        on = scratch.cut(caught.join(caught.select(F.col("v").alias("up"), F.col("up").alias("up2")), "up").select("v", F.col("up2").alias("up")), "caught")
        now = on.select("up").distinct().count()
        caught = on
        if now == images:
            break
        images = now
    ring = caught.select(F.col("up").alias("v")).distinct().join(nodes, "v").select("v", F.col("parent").alias("next"), F.col("name").alias("least"))
    while True:
        ahead = ring.select(F.col("v").alias("next"), F.col("next").alias("next2"), F.col("least").alias("least2"))
        moved = scratch.cut(ring.join(ahead, "next").select("v", F.col("next2").alias("next"), F.least("least", "least2").alias("least"), (F.col("least2") < F.col("least")).alias("fell")), "ring")
        ring = moved.drop("fell")
        if moved.where("fell").isEmpty():
            break
    return caught.join(ring.select(F.col("v").alias("up"), F.col("least").alias("root")), "up").select("v", "root")


def _chains(forest: DataFrame, scratch: Scratch) -> Rounds:
    """(v, head, pos): each node's chain, named by its first node, and its place on it from 0.

    Pointers double along the chains; a node whose pointer has reached a head is written once, later rounds only look it up."""
    heavy = forest.where(F.col("parent").isNotNull()).groupBy("parent").agg(F.min_by("v", F.struct((-F.col("size")).alias("s"), "name")).alias("v"))
    waiting = scratch.cut(heavy.select("v", F.col("parent").alias("head"), F.lit(1).cast("long").alias("pos")), "chain")
    heads = forest.join(waiting.select("v"), "v", "left_anti").select("v", F.col("v").alias("head"), F.lit(0).cast("long").alias("pos"))
    done = Rounds(forest.sparkSession, "chains")
    done.add(heads)
    while not waiting.isEmpty():
        known = done.all().withColumn("fixed", F.lit(True)).unionByName(waiting.withColumn("fixed", F.lit(False)))
        above = known.select(F.col("v").alias("head"), F.col("head").alias("head2"), F.col("pos").alias("pos2"), "fixed")
        moved = scratch.cut(waiting.join(above, "head").select("v", F.col("head2").alias("head"), (F.col("pos") + F.col("pos2")).alias("pos"), "fixed"), "chain")
        done.add(moved.where("fixed").drop("fixed"))
        waiting = moved.where("not fixed").drop("fixed")
    return done


def _offsets(starts: DataFrame) -> DataFrame:
    """(head, offset): what the sizes of a light child's earlier siblings add up to; starts has head, parent, size."""
    salted = starts.withColumn("g", F.pmod(F.xxhash64("head"), F.lit(_SALT)))
    sums = salted.groupBy("parent", "g").agg(F.sum("size").alias("s"))
    before = W.partitionBy("parent").orderBy("g").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select("parent", "g", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    inner = W.partitionBy("parent", "g").orderBy("head").rowsBetween(W.unboundedPreceding, -1)
    return salted.withColumn("own", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(base, ["parent", "g"]).select("head", (F.col("base") + F.col("own")).alias("offset"))


def hierarchy(df: DataFrame, node: str, ref: str, order: str, paths: bool = True) -> DataFrame:
    """One row per distinct node: name, root, depth, parent_name; with `paths` also path (array, root
    first). `first` is the node's number in depth-first order within its tree, n_descendants how many
    numbers follow that belong to it."""
    nodes = _nodes(df, node, ref, order)
    scratch = Scratch()
    sizes, caught = _sizes(nodes, scratch)
    circles = None if caught is None else cut(_circles(nodes, caught, scratch), "circles")
    forest = nodes.join(sizes, "v")
    if circles is not None:
        forest = forest.join(circles.select("v"), "v", "left_anti")
    forest = cut(forest, "forest")
    scratch.clear()
    chain = _chains(forest, scratch)
    labelled = cut(forest.join(chain.all(), "v"), "labelled")  # v, name, parent, size, head, pos
    chain.drop()
    scratch.clear()
    drop_cut(forest)
    starts = labelled.where("pos = 0").select("head", "name", "parent", "size")
    members = None
    if paths:
        # A chain is no longer than the longest path, which is one value of the result.
        members = labelled.groupBy("head").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("members"))
    above = labelled.select(F.col("v").alias("parent"), F.col("head").alias("up_head"), F.col("pos").alias("up_pos"), F.col("size").alias("up_size"))
    light = starts.where(F.col("parent").isNotNull())
    heavy_size = labelled.where("pos > 0").select("parent", F.col("size").alias("heavy_size"))
    waiting = light.join(_offsets(light.select("head", "parent", "size")), "head").join(above, "parent").join(heavy_size, "parent")
    waiting = cut(waiting.select("head", "up_head", "up_pos", (1 + F.col("heavy_size") + F.col("offset")).alias("step")), "waiting")
    level = starts.where(F.col("parent").isNull()).select("head", F.lit(0).cast("long").alias("depth0"), F.col("name").alias("root"), F.lit(0).cast("long").alias("first0"))
    if paths:
        level = level.join(members, "head").withColumn("before", F.array().cast("array<string>"))
    done = Rounds(df.sparkSession, "levels")
    level = done.add(level)
    while not level.isEmpty():
        fields = [(F.col("depth0") + F.col("up_pos") + 1).alias("depth0"), "root", (F.col("first0") + F.col("up_pos") + F.col("step")).alias("first0")]
        following = waiting.join(level.withColumnRenamed("head", "up_head"), "up_head")
        if paths:
            grown = F.concat("before", F.slice("members", F.lit(1), (F.col("up_pos") + 1).cast("int"))).alias("before")
            level = done.add(following.select("head", *fields, grown).join(members, "head").select(*level.columns))
        else:
            level = done.add(following.select("head", *fields))
    drop_cut(waiting)
    names = nodes.select(F.col("v").alias("parent"), F.col("name").alias("parent_name"))
    tree = labelled.join(done.all(), "head").select(
        "name", "root", (F.col("depth0") + F.col("pos")).cast("int").alias("depth"), "parent", (F.col("first0") + F.col("pos")).alias("first"), (F.col("size") - 1).alias("n_descendants"),
        *([F.concat("before", F.slice("members", F.lit(1), (F.col("pos") + 1).cast("int"))).alias("path")] if paths else []),
    )
    if circles is not None:
        lost = circles.join(nodes, "v").select(
            "name", "root", F.lit(-1).alias("depth"), "parent", F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("n_descendants"), *([F.lit(None).cast("array<string>").alias("path")] if paths else [])
        )
        tree = tree.unionByName(lost)
    with_parent = tree.where(F.col("parent").isNotNull()).join(names, "parent").drop("parent")
    return with_parent.unionByName(tree.where(F.col("parent").isNull()).withColumn("parent_name", F.lit(None).cast("string")).drop("parent"))


def descendants(tree: DataFrame, block: int = 4096) -> DataFrame:
    """(name, descendant, distance) of every node and each of its descendants, from the intervals of hierarchy().

    A node's interval is cut into blocks of numbers before it is unfolded, so no row holds a tree; a
    number meets exactly one node of its tree, so the join's work is the result's size."""
    n = F.col("n_descendants")
    wide = tree.where(n > 0).select("root", "name", F.col("depth").alias("top"), "first", n, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / block))).alias("b"))
    wide = wide.repartition("root", "first", "b")
    low = F.col("b") * block + 1
    asked = wide.select("root", "name", "top", F.explode(F.sequence(F.col("first") + low, F.col("first") + F.least(low + block - 1, n))).alias("first"))
    below = tree.where(F.col("depth") >= 0).select("root", "first", F.col("name").alias("descendant"), "depth")
    return asked.join(below, ["root", "first"]).select("name", "descendant", (F.col("depth") - F.col("top")).alias("distance"))
