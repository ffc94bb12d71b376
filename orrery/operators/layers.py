"""Strong components and levels of graphs of any size, by one path of code.

Every round peels the graph: nodes that nothing points at or that point at nothing leave, and chains (nodes with one edge
in and one out) are followed to their ends by pointer jumping, so a chain of n edges takes rounds in the logarithm of n,
and become one edge. What leaves is settled backwards from what is left. A round is some joins and is checkpointed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.durable import written as cut

#: Rounds that peel less than a SLOW-th of the nodes are followed by a split of what is left.
SLOW = 8


def among(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose two ends are among ``ids`` (id)."""
    ids = ids.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(edges.columns)


def follow(links: DataFrame) -> DataFrame:
    """(id, side, to, w, b, low, open): pointers (id, side, to, w, b, low), of which no two share a side and ``to``, each
    followed along its side until ``to`` is no ``id``; ``open`` are those that go round in a cycle.

    Weights add up along the way: x at the end becomes max(x + w, b) at the start. ``low`` is the least on the way, on a
    cycle of all. Each round jumps four times as far as the last.
    """
    ids = links.select(F.col("id").alias("to"), "side", F.lit(True).alias("open"))
    at = cut(links.join(ids, ["to", "side"], "left").select(*links.columns, F.coalesce("open", F.lit(False)).alias("open")))
    left, before, span = at.filter("open").count(), None, 1
    while left and not (left == before and span >= left):  # where a round closes none, cycles are all that is left
        at = cut(jump(jump(at)))
        before, left, span = left, at.filter("open").count(), span * 4
    return at


def jump(at: DataFrame) -> DataFrame:
    then = at.select(F.col("id").alias("to"), "side", *[F.col(c).alias(f"_{c}") for c in ("to", "w", "b", "low", "open")])
    far = at.filter("open").join(then, ["to", "side"])
    far = far.select("id", "side", F.col("_to").alias("to"), (F.col("w") + F.col("_w")).alias("w"), F.greatest(F.col("_b") + F.col("w"), "b").alias("b"), F.least("low", "_low").alias("low"), F.col("_open").alias("open"))
    return at.filter("NOT open").select(far.columns).unionByName(far)


def beside(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` with the numbers of edges in and out (i, o), and the other end of an edge in and of one out (prev, next)."""
    ins = edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("i"), F.max("source").alias("prev"))
    outs = edges.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("o"), F.max("target").alias("next"))
    zero = F.lit(0).cast("long")
    return nodes.join(ins, "id", "left").join(outs, "id", "left").withColumn("i", F.coalesce("i", zero)).withColumn("o", F.coalesce("o", zero))


def strongly_connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component, size), component being its smallest member: nodes that reach each other. Edges with an unknown end
    are left out.

    Nodes without an edge in or out are alone. A chain belongs to the component of its ends if they share one, else its
    nodes are alone; a cycle of nothing but chain is a component. Where little is left to peel, the least reaching and the
    least reached node (in an order by hash) are spread: where they agree they name a component, and edges between nodes
    that differ in them can't be inside one. No closure is built.
    """
    left = cut(nodes.select("id").distinct())
    live = cut(among(edges.select("source", "target").filter("source <> target").distinct(), left))
    done, held = [], []
    while True:
        around = cut(beside(left, live))
        n = around.agg(F.count(F.lit(1)), F.count(F.when(F.expr("i = 0 OR o = 0"), 1)), F.count(F.when(F.expr("i = 1 AND o = 1"), 1))).first()
        if not n[0]:
            break
        done.append(around.filter("i = 0 OR o = 0").select("id", F.col("id").alias("component")))
        if n[2]:
            chain = around.filter("i = 1 AND o = 1").select("id", F.lit(0).alias("w"), F.lit(0).alias("b"), F.col("id").alias("low"), "prev", "next")
            sides = [chain.select("id", F.lit(s).alias("side"), F.col(c).alias("to"), "w", "b", "low") for s, c in enumerate(("prev", "next"))]
            ways = follow(sides[0].unionByName(sides[1]))
            done.append(ways.filter("open AND side = 0").select("id", F.col("low").alias("component")))
            pick = lambda s, c: F.max(F.when(F.col("side") == s, F.col("to"))).alias(c)
            held.append(cut(ways.filter("NOT open").groupBy("id").agg(pick(0, "head"), pick(1, "tail"))))
            live = live.unionByName(held[-1].filter("head <> tail").select(F.col("head").alias("source"), F.col("tail").alias("target"))).distinct()
        left = around.filter("NOT (i = 0 OR o = 0) AND NOT (i = 1 AND o = 1)").select("id")
        live = cut(among(live, left))
        if n[0] > n[1] + n[2] and (n[1] + n[2]) * SLOW < n[0]:
            ranked = cut(left.select("id", F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("r")).alias("label")))
            labels = cut(spread(ranked, live, "source", "target").withColumnRenamed("label", "f").join(spread(ranked, live, "target", "source").withColumnRenamed("label", "b"), "id"))
            done.append(labels.filter("f = b").select("id", F.col("f.r").alias("component")))
            left = labels.filter("f <> b").select("id", "f", "b")
            a, b = (left.select(F.col("id").alias(end), F.col("f").alias(f"f{k}"), F.col("b").alias(f"b{k}")) for k, end in enumerate(("source", "target")))
            live = cut(live.join(a, "source").join(b, "target").filter("f0 = f1 AND b0 = b1").select("source", "target"))
            left = left.select("id")
    if not done:
        return nodes.limit(0).select("id", F.col("id").alias("component"), F.lit(0).cast("long").alias("size"))
    known = reduce(DataFrame.unionByName, done)
    for chain in reversed(held):
        known = cut(known)
        of = lambda end, c: known.select(F.col("id").alias(end), F.col("component").alias(c))  # noqa: B023, E731
        met = chain.join(of("head", "x"), "head").join(of("tail", "y"), "tail")
        known = known.unionByName(met.select("id", F.when(F.col("x") == F.col("y"), F.col("x")).otherwise(F.col("id")).alias("component")))
    known = cut(known)
    names = known.groupBy("component").agg(F.min("id").alias("name"), F.count(F.lit(1)).alias("size"))
    return known.join(names, "component").select("id", F.col("name").alias("component"), "size")


def spread(labels: DataFrame, edges: DataFrame, frm: str, to: str) -> DataFrame:
    """(id, label): the least label that reaches a node along edges. What a label's own node was reached by reaches its
    followers too, which shortens long ways to jumps."""
    while True:
        sent = edges.join(labels, F.col(frm) == F.col("id")).groupBy(F.col(to).alias("id")).agg(F.min("label").alias("new"))
        near = labels.join(sent, "id", "left").select("id", F.least("label", F.coalesce("new", "label")).alias("label"), F.col("label").alias("was"))
        over = labels.select(F.col("id").alias("_id"), F.col("label").alias("far"))
        after = near.join(over, F.col("label.r") == F.col("_id")).select("id", F.least("label", "far").alias("label"), "was")
        after = cut(after.select("id", "label", (F.col("label") < F.col("was")).alias("moved")))
        labels = after.select("id", "label")
        if after.filter("moved").isEmpty():
            return labels


def levels(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): 0 for components that nobody points at, else 1 + the greatest level of those that do; members share it.

    An edge takes its source's level x to max(x + w, b), so a chain of edges is an edge. Components that nothing points at
    hand on their level and leave; those that point at nothing wait for their sources.
    """
    of = components.select("id", "component")
    dag = edges.join(of.select(F.col("id").alias("source"), F.col("component").alias("s")), "source").join(of.select(F.col("id").alias("target"), F.col("component").alias("t")), "target")
    live = cut(dag.filter("s <> t").select(F.col("s").alias("source"), F.col("t").alias("target"), F.lit(1).alias("w"), F.lit(0).alias("b")).distinct())
    left = of.select(F.col("component").alias("id"), F.lit(0).alias("base")).distinct()
    steps = []
    while True:
        around = cut(beside(left, live))
        if around.isEmpty():
            break
        chain = around.filter("i = 1 AND o = 1").select(F.col("id").alias("target"), "base").join(live, "target")
        ways = follow(chain.select(F.col("target").alias("id"), F.lit(0).alias("side"), F.col("source").alias("to"), "w", F.greatest("b", "base").alias("b"), F.lit(0).alias("low")))
        ways = ways.select("id", F.col("to").alias("head"), F.col("w").alias("hw"), F.col("b").alias("hb"))
        inner = around.filter("i = 1 AND o = 1").select("id")
        rest = live.join(inner.withColumnRenamed("id", "target"), "target", "left_anti").join(ways, F.col("source") == F.col("id"), "left")
        on = F.col("head").isNotNull()
        rest = rest.select(F.coalesce("head", "source").alias("source"), "target", F.when(on, F.col("w") + F.col("hw")).otherwise(F.col("w")).alias("w"), F.when(on, F.greatest(F.col("hb") + F.col("w"), "b")).otherwise(F.col("b")).alias("b"))
        rest = cut(rest.groupBy("source", "target").agg(F.max("w").alias("w"), F.max("b").alias("b")))
        roots = around.filter("i = 0").select("id", F.col("base").alias("level"))
        handed = rest.join(roots, F.col("source") == F.col("id")).groupBy(F.col("target").alias("id")).agg(F.max(F.greatest(F.col("level") + F.col("w"), "b")).alias("handed"))
        later = around.filter("i > 0 AND NOT (i = 1 AND o = 1)").join(handed, "id", "left").select("id", F.greatest("base", F.coalesce("handed", F.lit(0))).alias("base"), "o")
        later = cut(later)
        ends, left = later.filter("o = 0").select("id", "base"), later.filter("o > 0").select("id", "base")
        waiting = cut(ends.join(rest.join(roots.select(F.col("id").alias("source")), "source", "left_anti").withColumnRenamed("target", "id"), "id", "left"))
        steps.append((roots, ways, waiting))
        live = cut(among(rest, left))
    known = None
    for roots, ways, waiting in reversed(steps):
        known = cut(roots if known is None else known.unionByName(roots))
        at = known.select(F.col("id").alias("source"), "level")
        last = waiting.join(at, "source", "left").groupBy("id").agg(F.max(F.greatest("base", F.coalesce(F.col("level") + F.col("w"), F.lit(0)), F.coalesce("b", F.lit(0)))).alias("level"))
        between = ways.join(known.select(F.col("id").alias("head"), "level"), "head").select("id", F.greatest(F.col("level") + F.col("hw"), "hb").alias("level"))
        known = known.unionByName(last).unionByName(between)
    if known is None:
        return of.select("id", F.lit(0).alias("level"))
    return of.join(known.withColumnRenamed("id", "component"), "component").select("id", "level")
