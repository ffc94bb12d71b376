"""Communities by modularity and edges by betweenness, of graphs of any size, as rounds of joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.durable import written

#: A community of more than this share of the nodes, and of more than SPLIT nodes, is split once more.
SHARE, SPLIT = 4, 10
#: A level ends where no node gains by moving, or after so many rounds in a row without a better modularity.
PATIENCE, LEAST = 3, 1e-9


def moved(edges: DataFrame) -> tuple[DataFrame, bool]:
    """((id, c), whether any moved): nodes of weighted edges in both directions (id, n, w), loops twice their weight, moved
    between communities as long as modularity rises.

    In each round every node looks for the community it gains most by; of those that want to move, a set of which no two are
    neighbours does, a colour of the graph: the nodes with the greatest number among their neighbours, numbers being drawn
    anew each round by hash. So a mover's neighbours stand still, and what it gains is what it saw; only communities'
    weights can change under it. The round of the greatest modularity is kept.
    """
    degree = edges.groupBy("id").agg(F.sum("w").alias("k"))
    nodes = written(degree.select("id", "k", F.col("id").alias("c")))
    total = nodes.agg(F.sum("k")).first()[0] or 0.0
    if not total:
        return nodes.select("id", "c"), False
    best, top, since, n, any_moved = nodes, None, 0, 0, False
    while True:
        sums = nodes.groupBy("c").agg(F.sum("k").alias("s"))
        votes = edges.join(nodes.select(F.col("id").alias("n"), F.col("c").alias("t")), "n").groupBy("id", "t").agg(F.sum(F.when(F.col("id") != F.col("n"), F.col("w")).otherwise(0.0)).alias("x"), F.sum("w").alias("all"))
        at = votes.unionByName(nodes.select("id", F.col("c").alias("t"), F.lit(0.0).alias("x"), F.lit(0.0).alias("all"))).groupBy("id", "t").agg(F.sum("x").alias("x"), F.sum("all").alias("all"))
        at = at.join(nodes, "id").join(sums.withColumnRenamed("c", "t"), "t")
        own = F.col("t") == F.col("c")
        gain = F.round(F.col("x") - (F.col("s") - F.when(own, F.col("k")).otherwise(0.0)) * F.col("k") / total, 9)
        seen = written(at.groupBy("id").agg(
            F.min(F.struct((-gain).alias("g"), "t")).alias("b"), F.max(F.when(own, gain)).alias("g"), F.sum(F.when(own, F.col("all"))).alias("inside"), F.max(F.when(own, F.col("s"))).alias("s"), F.first("c").alias("c"), F.first("k").alias("k"),
        ))
        gains = -F.col("b.g") > F.col("g") + LEAST
        inside, squares, n_wants = seen.agg(F.sum("inside"), F.sum(F.col("k") * F.col("s")), F.count(F.when(gains, 1))).first()
        quality = inside / total - squares / total / total
        if top is None or quality > top + LEAST:
            best, top, since = nodes, quality, 0
        else:
            since += 1
        wants = seen.filter(gains).select("id", F.col("b.t").alias("to"), F.struct(F.xxhash64("id", F.lit(n)).alias("h"), "id").alias("p"))
        if since >= PATIENCE or not n_wants:
            return best.select("id", "c"), any_moved
        lower = edges.filter("id <> n").join(wants.select("id", "p"), "id").join(wants.select(F.col("id").alias("n"), F.col("p").alias("q")), "n").filter("p < q").select("id").distinct()
        goes = wants.join(lower, "id", "left_anti").select("id", "to")
        nodes = written(seen.select("id", "k", "c").join(goes, "id", "left").select("id", "k", F.coalesce("to", "c").alias("c")))
        any_moved, n = True, n + 1


def modules(edges: DataFrame) -> DataFrame:
    """(id, community), the smallest member: levels of moves, each on the graph of the last one's communities."""
    edges = written(edges)
    members = written(edges.select("id", F.col("id").alias("community")).distinct())
    while True:
        at, any_moved = moved(edges)
        if not any_moved:
            return members
        names = at.groupBy("c").agg(F.min("id").alias("name"))  # nodes are named by their smallest members
        at = written(at.join(names, "c").select("id", "name"))
        members = written(members.join(at.withColumnRenamed("id", "community"), "community").select("id", F.col("name").alias("community")))
        up = edges.join(at, "id").join(at.select(F.col("id").alias("n"), F.col("name").alias("to")), "n")
        edges = written(up.groupBy(F.col("name").alias("id"), F.col("to").alias("n")).agg(F.sum("w").alias("w")))


def louvain(pairs: DataFrame) -> DataFrame:
    """(id, community): communities of undirected pairs (a, b) by modularity, numbered by size and then by smallest node.

    Rounds move sets of nodes that aren't neighbours, so the result depends neither on partitions nor on the order of rows;
    ties go to the smallest community. A community of more than a quarter of the nodes, and more than ten, is split once
    more by itself; there are three of these at most. Loops and repeated pairs don't count.
    """
    pairs = written(pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    both = written(pairs.select(F.col("a").alias("id"), F.col("b").alias("n"), F.lit(1.0).alias("w")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("n"), F.lit(1.0).alias("w"))))
    parts = modules(both)
    n = parts.count()
    large = [r.community for r in parts.groupBy("community").count().filter(F.col("count") > max(SPLIT, n // SHARE)).collect()]  # three at most
    for name in large:
        inner = parts.filter(F.col("community") == name).select("id")
        among = both.join(inner, "id", "left_semi").join(inner.withColumnRenamed("id", "n"), "n", "left_semi").select("id", "n", "w")
        parts = written(parts.join(modules(among).withColumnRenamed("community", "split"), "id", "left").select("id", F.coalesce("split", "community").alias("community")))
    sizes = parts.groupBy("community").agg((-F.count(F.lit(1))).alias("n"))
    return parts.join(numbered(sizes, ["n", "community"], "rank"), "community").select("id", F.col("rank").alias("community"))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place in ``order`` from 0, without gathering them: dealt by range, numbered in each partition, and
    shifted by the rows of the partitions before, of which there is one number each."""
    dealt = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each partition
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + F.col("_before")
    return dealt.join(F.broadcast(before), "_part").select(*rows.columns, place.cast("int").alias(name))


def betweenness(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """(a, b, betweenness) of undirected pairs (a, b) from the shortest paths of ``sources`` (id), all nodes or a sample.

    Forward, all sources take a step a round: a table of (source, node, ways to it) for each depth, and the steps that made
    it. Backward from the deepest, each node's share of what is beyond it goes to the steps into it, by their ways. Tables
    have a row for each source and node reached, so a sample bounds them.
    """
    pairs = written(pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    near = written(pairs.select(F.col("a").alias("v"), F.col("b").alias("id")).unionByName(pairs.select(F.col("b").alias("v"), F.col("a").alias("id"))))
    depth = written(sources.select("id").distinct().join(near.select(F.col("v").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("s"), "id", F.lit(1.0).alias("ways")))
    seen, steps = [depth.select("s", "id")], []
    while True:
        step = depth.withColumnRenamed("id", "v").withColumnRenamed("ways", "before").join(near, "v")
        for old in seen[-2:]:  # a neighbour of this depth is of the last, of this or of the next one
            step = step.join(old, ["s", "id"], "left_anti")
        step = written(step.select("s", "v", "id", "before"))
        depth = written(step.groupBy("s", "id").agg(F.sum("before").alias("ways")))
        if depth.isEmpty():
            break
        seen.append(depth.select("s", "id"))
        steps.append((step, depth))
    shares, debt = [], None
    for step, reached in reversed(steps):
        owed = reached.withColumn("debt", F.lit(0.0)) if debt is None else reached.join(debt, ["s", "id"], "left").withColumn("debt", F.coalesce("debt", F.lit(0.0)))
        share = written(step.join(owed, ["s", "id"]).select("s", "v", "id", (F.col("before") / F.col("ways") * (F.col("debt") + 1)).alias("share")))
        debt = share.groupBy("s", F.col("v").alias("id")).agg(F.sum("share").alias("debt"))
        shares.append(share.select(F.least("v", "id").alias("a"), F.greatest("v", "id").alias("b"), "share"))
    if not shares:
        return pairs.limit(0).select("a", "b", F.lit(0.0).alias("betweenness"))
    return reduce(DataFrame.unionByName, shares).groupBy("a", "b").agg(F.sum("share").alias("betweenness"))
