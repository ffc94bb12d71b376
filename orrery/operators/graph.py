"""Property graphs as DataFrames: edges are (source, target, relation, score, ...), nodes (id, kind, label, ...)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions.durable import cut, file_system
from orrery.functions.expressions import case

DIRECTIONAL = ("calls", "depends-on", "cross-module", "contains")


# --- construction -------------------------------------------------------------------------------------------------


def upsert_edges(edges: DataFrame, directed: bool = True) -> DataFrame:
    """One edge for each (source, target, relation), the one of the greatest score with all its columns; of equal scores the
    one whose other columns come last. Undirected graphs take A-B as B-A, with the winner's own direction as
    ``original_direction`` (source->target)."""
    a, b = (F.col("source"), F.col("target")) if directed else (F.least("source", "target"), F.greatest("source", "target"))
    rest = [c for c in edges.columns if c not in ("source", "target", "relation", "score")]
    more = [] if directed else [F.concat("source", F.lit("->"), "target").alias("original_direction")]
    best = F.max(F.struct("score", *rest, *more)).alias("_e")
    return edges.groupBy(a.alias("source"), b.alias("target"), "relation").agg(best).select("source", "target", "relation", "_e.*")


def upsert_nodes(batches: DataFrame) -> DataFrame:
    """Nodes (id, rank, label, kind, metadata map) merged by id: the last rank's label and kind, metadata of all with later keys winning."""
    last = F.max_by(F.struct("label", "kind"), "rank")
    keys = batches.select("id", "rank", F.explode_outer("metadata").alias("k", "v")).filter("k IS NOT NULL")
    merged = keys.groupBy("id", "k").agg(F.max_by("v", "rank").alias("v")).groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("metadata"))
    return batches.groupBy("id").agg(last.alias("_l")).join(merged, "id", "left").select("id", "_l.label", "_l.kind", "metadata")


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends exist."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(edges.columns)


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id").distinct()
    tagged = edges.join(ids.select(F.col("id").alias("source"), F.lit(1).alias("_s")), "source", "left").join(ids.select(F.col("id").alias("target"), F.lit(1).alias("_t")), "target", "left")
    return tagged.filter("_s IS NULL OR _t IS NULL").select(edges.columns)


def simple_undirected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) with a < b, once each: no dangling ends, no loops, no containment."""
    kept = valid_edges(edges.filter("relation <> 'contains' AND source <> target"), nodes)
    return kept.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()


def passing(edges: DataFrame, relations: list[str] | None = None, least: float = 0.65) -> DataFrame:
    """Edges of the relations whose score reaches ``least``; edges without a score don't."""
    kept = edges.filter(F.col("score") >= least)
    return kept.filter(F.col("relation").isin(relations)) if relations else kept


# --- degrees ------------------------------------------------------------------------------------------------------


def degree_total(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree): loops count twice, nodes without edges 0."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_in_out(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    counts = ends.groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
    return nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def coupling_degree(edges: DataFrame) -> DataFrame:
    """Degrees without containment; a loop counts once."""
    ends = F.when(F.col("source") == F.col("target"), F.array("source")).otherwise(F.array("source", "target"))
    return edges.filter("relation <> 'contains'").select(F.explode(ends).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def primary_relation(edges: DataFrame) -> DataFrame:
    """(id, relation, n): the most frequent relation at each node, ties to the first by name."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"), "relation").groupBy("id", "relation").agg(F.count(F.lit(1)).alias("n"))
    return ends.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("m"), "relation")).alias("b")).select("id", "b.relation", (-F.col("b.m")).alias("n"))


def cohesion(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(community, size, internal, cohesion) from members (id, community) and undirected pairs (a, b); one member: 1."""
    inside = pairs.join(members.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(members.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
    inside = inside.filter("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count(F.lit(1)).alias("internal"))
    out = members.groupBy("community").agg(F.count(F.lit(1)).alias("size")).join(inside, "community", "left").withColumn("internal", F.coalesce("internal", F.lit(0)))
    return out.withColumn("cohesion", F.when(F.col("size") <= 1, 1.0).otherwise(F.round(F.col("internal") / (F.col("size") * (F.col("size") - 1) / 2), 3)))


def hubs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree): degree above max(mean + 2 population deviations, 2), no packages; containment doesn't count."""
    degrees = degree_total(nodes, edges.filter("relation <> 'contains'"))
    line = degrees.agg(F.greatest(F.avg("degree") + 2 * F.stddev_pop("degree"), F.lit(2.0)).alias("line"))  # one row
    out = degrees.join(F.broadcast(line), F.col("degree") > F.col("line"))
    return out.join(nodes.filter("kind <> 'package'").select("id"), "id", "left_semi").select("id", "degree")


def top_in_group(rows: DataFrame, group: str, by: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; a group limit keeps n rows a task before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*by))).filter(F.col("rank") <= n)


# --- traversal ----------------------------------------------------------------------------------------------------


def adjacency(edges: DataFrame, direction: str, *more: str) -> DataFrame:
    """(at, next, score, ...): upstream goes from a target to its sources."""
    down = edges.select(F.col("source").alias("at"), F.col("target").alias("next"), "score", *more)
    up = edges.select(F.col("target").alias("at"), F.col("source").alias("next"), "score", *more)
    return {"downstream": down, "upstream": up, "both": down.unionByName(up)}[direction]


def bucket(node: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(buckets)).cast("int")


#: Edges of a bucket, about, buckets at least, and ids of a frontier that are handed to the scan at most.
PER_BUCKET, FEWEST, HANDED = 2_000_000, 16, 1000


def store_adjacency(edges: DataFrame, path: str, buckets: int | None = None) -> None:
    """Write ``edges`` twice, by source and by target: a folder for each relation and bucket of the node they start from.

    A hop reads the buckets of its frontier; there are as many as leave about PER_BUCKET edges in each, a power of two. They
    are dealt to a number of parts that grows with them, which aren't put together again, so what a task sorts is bounded.
    """
    if buckets is None:
        buckets = FEWEST
        n = edges.count()
        while buckets * PER_BUCKET < n:
            buckets *= 2
    parts = 2 * buckets  # most edges are of a few relations
    for direction in ("downstream", "upstream"):
        rows = adjacency(edges, direction, "relation").withColumn("bucket", bucket(F.col("at"), buckets))
        rows.repartition(parts, "relation", "bucket").sortWithinPartitions("relation", "bucket", "at").write.partitionBy("relation", "bucket").parquet(f"{path}/{direction}-{buckets}")


def stored_hops(spark: SparkSession, path: str, direction: str, relations: list[str] | None = None, least: float | None = None) -> Callable[[DataFrame], DataFrame]:
    """One hop over a stored adjacency: reads the frontier's buckets only, and of these, whose files are sorted by node, the
    row groups that may hold one of its ids where they are HANDED at most. Bucket numbers and these ids come to the driver."""
    fs, at = file_system(spark, path)
    folders = {s.getPath().getName().rpartition("-")[0]: s.getPath().getName() for s in fs.listStatus(at)}

    def hop(frontier: DataFrame) -> DataFrame:
        sides = []
        for d in ("downstream", "upstream") if direction == "both" else (direction,):
            buckets = int(folders[d].rpartition("-")[2])
            wanted = [r[0] for r in frontier.select(bucket(F.col("id"), buckets)).distinct().collect()]
            few = [r[0] for r in frontier.select("id").limit(HANDED + 1).collect()]
            kind = dict(frontier.dtypes)["id"]
            rows = spark.read.schema(f"at {kind}, next {kind}, score double, relation string, bucket int").parquet(f"{path}/{folders[d]}").filter(F.col("bucket").isin(wanted))
            rows = rows.filter(F.col("at").isin(few)) if len(few) <= HANDED else rows
            rows = rows.filter(F.col("relation").isin(relations)) if relations else rows
            sides.append(rows.filter(F.col("score") >= least) if least is not None else rows)
        every = sides[0].unionByName(sides[1]) if len(sides) > 1 else sides[0]
        return frontier.join(every.select("at", "next", "score", "relation"), F.col("id") == F.col("at"))

    return hop


def bfs(edges: DataFrame | Callable[[DataFrame], DataFrame], starts: DataFrame, depth: int, direction: str = "upstream", budget: int | None = None, visited: DataFrame | None = None) -> DataFrame:
    """(id, depth, score, parent, path) of nodes reached from ``starts`` (id) in 1..depth hops, each at its least depth.

    ``edges`` are edges, or a hop over stored ones. Score and parent are those of the best edge into the node at that depth
    (greatest score, then smallest parent); the path leads from the start to the node. A visited set is kept, so cycles
    end, and neither starts nor nodes ``visited`` (id) before are reached. A budget stops before the hop after which at
    least that many nodes are reached. Every hop is one join of the frontier and one anti-join, checkpointed.
    """
    hop = edges if callable(edges) else (lambda hops: lambda f: f.join(hops, F.col("id") == F.col("at")))(adjacency(edges, direction))
    frontier = cut(starts.select("id").distinct().withColumn("path", F.array("id")))
    seen = frontier.select("id") if visited is None else frontier.select("id").unionByName(visited.select("id"))
    found = None
    for n in range(1, depth + 1):
        step = hop(frontier).select(F.col("next").alias("id"), "score", F.col("at").alias("parent"), "path")
        step = step.join(seen, "id", "left_anti").groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "parent", "path")).alias("b"))
        step = cut(step.select("id", F.lit(n).alias("depth"), (-F.col("b.s")).alias("score"), F.col("b.parent").alias("parent"), F.concat("b.path", F.array("id")).alias("path")))
        if step.isEmpty():
            break
        found = step if found is None else found.unionByName(step)
        frontier = step.select("id", "path")
        seen = seen.unionByName(step.select("id"))
        if budget and found.count() >= budget:
            break
    if found is None:
        return starts.limit(0).select("id", F.lit(0).alias("depth"), F.lit(0.0).alias("score"), F.col("id").alias("parent"), F.array("id").alias("path"))
    return found


#: The greatest depth of a traversal for callers, its default score and numbers of nodes.
DEEPEST, LEAST, NODES, MOST = 5, 0.65, 200, 1000


def traverse(
    edges: DataFrame, starts: DataFrame, depth: int = 2, direction: str = "upstream", least: float = LEAST, budget: int | None = NODES, relations: tuple[str, ...] = ("calls",), visited: DataFrame | None = None
) -> tuple[DataFrame, list[str]]:
    """((id, depth, score, reason, path), warnings): who is reached, why and on which way; without a budget (None) all of them.

    Warnings: depth-clamped beyond DEEPEST, budget-truncated where nodes are left out (the nearest and best scored stay),
    missing-confidence-score where edges have no score (they are not followed), confidence-filtered-all where no edge at
    the starts has the score asked for.
    """
    of = edges.filter(F.col("relation").isin(list(relations)))
    kept, budget = of.filter(F.col("score") >= least), None if budget is None else max(1, min(budget, MOST))
    reached = bfs(kept, starts, min(depth, DEEPEST), direction, budget, visited)
    warnings = []
    if depth > DEEPEST:
        warnings.append("depth-clamped")
    near = adjacency(of, direction).join(starts.select(F.col("id").alias("at")).distinct(), "at", "left_semi")
    first = near.agg(F.count(F.lit(1)), F.count("score"), F.count(F.when(F.col("score") >= least, 1))).first()
    if first[0] > first[1]:
        warnings.append("missing-confidence-score")
    if depth > 0 and first[1] and not first[2]:
        warnings.append("confidence-filtered-all")
    rows = reached.withColumn("reason", F.concat(F.lit("called via "), "parent", F.lit(" -> "), "id")).select("id", "depth", "score", "reason", "path")
    if budget is None:
        return rows, warnings
    if reached.limit(budget + 1).count() > budget:
        warnings.append("budget-truncated")
        rows = rows.orderBy("depth", F.desc("score"), "id").limit(budget)
    elif reached.limit(budget).count() == budget and not bfs(kept, reached.filter(F.col("depth") < min(depth, DEEPEST)).select("id"), 1, direction, visited=reached.select("id").unionByName(starts.select("id"))).isEmpty():
        warnings.append("budget-truncated")
    return rows, warnings


def risk(direct: Column, transitive: Column) -> Column:
    return F.when((direct >= 10) | (transitive >= 50), "high").when((direct >= 3) | (transitive >= 15), "medium").otherwise("low")


def impact(edges: DataFrame | Callable[[DataFrame], DataFrame], starts: DataFrame, depth: int = 2, least: float = LEAST, direction: str = "upstream") -> DataFrame:
    """Affected nodes with score 1 / depth, and on each row the totals and risk tier of the whole; DEEPEST hops at most.
    A hop over stored edges has been given its relations and least score already."""
    hops = edges if callable(edges) else passing(edges, ["calls"], least)
    reached = bfs(hops, starts, min(depth, DEEPEST), direction)
    totals = reached.agg(F.coalesce(F.sum(F.when(F.col("depth") == 1, 1).otherwise(0)), F.lit(0)).alias("direct"), F.count(F.lit(1)).alias("total"))
    out = reached.join(F.broadcast(totals))  # one row
    return out.select("id", "depth", "score", (F.lit(1.0) / F.col("depth")).alias("impact"), "direct", "total", risk(F.col("direct"), F.col("total") - F.col("direct")).alias("risk"))


def path_lengths(edges: DataFrame, starts: DataFrame, depth: int = 5) -> DataFrame:
    """(id, depth): unweighted distances along edges up to ``depth``, however great that is; starts at 0."""
    return starts.select("id", F.lit(0).alias("depth")).unionByName(bfs(edges, starts, depth, "downstream").select("id", "depth"))


def shortest_path(edges: DataFrame, source: str, target: str, most: int = 10_000) -> list[str] | None:
    """The nodes of a shortest path along edges, of equal ones that of the best and smallest parents; None if there is none.

    Ends when the target is reached or nothing new is; ``most`` hops bound a path that would not fit a list.
    """
    spark = edges.sparkSession
    if source == target:
        return [source]
    hops, one = cut(adjacency(edges, "downstream")), spark.createDataFrame([(source,)], "id string")
    frontier, seen = cut(one.withColumn("path", F.array("id"))), one
    for _ in range(most):
        step = frontier.join(hops, F.col("id") == F.col("at")).select(F.col("next").alias("id"), "score", F.col("at").alias("parent"), "path").join(seen, "id", "left_anti")
        step = cut(step.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "parent", "path")).alias("b")).select("id", F.concat("b.path", F.array("id")).alias("path")))
        hit = step.filter(F.col("id") == target).first()
        if hit:
            return list(hit.path)
        if step.isEmpty():
            return None
        frontier, seen = step, seen.unionByName(step.select("id"))
    return None


def within_node_budget(nodes: DataFrame, budget: int = 50) -> DataFrame:
    """At most ``budget`` of ``nodes`` (id, tier, weight), with ``total`` and ``truncated``: starts (tier 0) go before paths
    (1), hubs (2) and others (3), then the heavier, then ids; a budget of 0 or less is 50."""
    budget = budget if budget > 0 else 50
    total = nodes.agg(F.count(F.lit(1)).alias("total"))  # one row
    kept = nodes.orderBy("tier", F.desc("weight"), "id").limit(budget)
    return kept.join(F.broadcast(total)).withColumn("truncated", F.col("total") > budget)


def question_subgraph(nodes: DataFrame, edges: DataFrame, question: str, budget: int = 50, depth: int = 2) -> DataFrame:
    """(id, depth, tier, weight, total, truncated) of nodes that the words of a question name, and of those around them; an
    empty question finds nothing.

    ``nodes``: id, label. A word in a label weighs 1, in an id 0.5; what is reached from there weighs its edge's score.
    """
    from orrery.operators.derivation import seeds
    from orrery.operators.retrieval import graph_terms

    spark = nodes.sparkSession
    terms = spark.createDataFrame([(question,)], "q string").select(F.explode(graph_terms(F.col("q"))).alias("term"))
    named = cut(seeds(nodes, terms).withColumn("depth", F.lit(0)).withColumn("tier", F.lit(0)))
    around = bfs(edges, named, depth, "both").select("id", F.col("score").alias("weight"), "depth", F.lit(3).alias("tier"))
    return within_node_budget(named.select("id", "weight", "depth", "tier").unionByName(around), budget)


def closure(edges: DataFrame) -> DataFrame:
    """(a, b) for every path from a to b of one edge or more, by doubling: a round for each factor of two in length."""
    paths = cut(edges.select(F.col("source").alias("a"), F.col("target").alias("b")).distinct())
    n = paths.count()
    while True:
        longer = paths.alias("x").join(paths.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"))
        paths = cut(paths.unionByName(longer).distinct())
        if (m := paths.count()) == n:
            return paths
        n = m


# --- analytics ----------------------------------------------------------------------------------------------------


def sampled(nodes: DataFrame, n: int = 1000, seed: int = 7) -> DataFrame:
    """At most ``n`` of ``nodes`` (id), by a seeded hash: the sources of a sampled betweenness."""
    return nodes.select("id").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)


def surprising(edges: DataFrame, members: DataFrame, between: DataFrame, top: int = 10) -> DataFrame:
    """Edges across communities or not EXTRACTED: 3 if across + weight of the level + 2 * betweenness share, 2 places."""
    weight = case(F.col("confidence"), {"AMBIGUOUS": 3, "INFERRED": 2, "EXTRACTED": 1})
    a, b = members.select(F.col("id").alias("source"), F.col("community").alias("cs")), members.select(F.col("id").alias("target"), F.col("community").alias("ct"))
    both = edges.filter("relation <> 'contains'").join(a, "source", "left").join(b, "target", "left")
    most = between.agg(F.greatest(F.max("betweenness"), F.lit(1.0)).alias("most"))
    scored = both.withColumn("a", F.least("source", "target")).withColumn("b", F.greatest("source", "target")).join(between, ["a", "b"], "left").join(F.broadcast(most))
    across = F.coalesce(F.col("cs") != F.col("ct"), F.lit(False))  # a node without a community crosses nothing
    score = F.round(F.when(across, 3).otherwise(0) + weight + 2 * F.coalesce("betweenness", F.lit(0.0)) / F.col("most"), 2)
    out = scored.filter(across | (F.col("confidence") != "EXTRACTED")).select("source", "target", "relation", across.alias("across"), score.alias("surprise"))
    return out.orderBy(F.desc("surprise"), "source", "target").limit(top)


def communities(pairs: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, community): synchronous label propagation, ties and the node's own label to the smallest; deterministic."""
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("n")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("n")))
    both = cut(both)
    labels = cut(both.select("id").distinct().withColumn("community", F.col("id")))
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("id", "n"), "n").groupBy("id", "community").agg(F.count(F.lit(1)).alias("v"))
        votes = votes.unionByName(labels.withColumn("v", F.lit(1).cast("long"))).groupBy("id", "community").agg(F.sum("v").alias("v"))
        after = cut(votes.groupBy("id").agg(F.min(F.struct((-F.col("v")).alias("m"), "community")).alias("b")).select("id", "b.community"))
        changed = after.join(labels, ["id", "community"], "left_anti")
        done, labels = changed.isEmpty(), after
        if done:
            break
    return labels


def direction_audit(edges: DataFrame) -> DataFrame:
    """``verdict`` of each edge, by the first rule that applies: semantic edges of documents are skipped, reversed ones incorrect."""
    semantic = F.col("relation").isin("references", "conceptually_related_to", "mentions")
    docs = F.array_contains(F.array("source_kind", "target_kind"), "document")
    verdict = (
        F.when(semantic & docs, "skipped").when((F.col("source_kind") == "document") & (F.col("target_kind") == "document"), "skipped")
        .when(F.col("reversed_by").isNotNull(), "incorrect").when(F.col("confidence") == "EXTRACTED", "correct").otherwise("suspicious")
    )
    return edges.withColumn("verdict", verdict)


def canonical_symbol(symbol: Column) -> Column:
    """Trimmed, without ./ in front; of several :: only the first parts file and symbol, the others become dots; null if malformed."""
    s = F.regexp_replace(F.trim(symbol), r"^(\./)+", "")
    parts = F.split(s, "::")
    joined = F.when(F.size(parts) > 2, F.concat(parts[0], F.lit("::"), F.array_join(F.slice(parts, F.lit(2), F.size(parts) - 1), "."))).otherwise(s)
    return F.when((s == "") | s.rlike(r"[\x00-\x1f]") | F.exists(parts, lambda p: p == ""), None).otherwise(joined)


def fuzzy(queries: DataFrame, nodes: DataFrame, limit: int = 5, spread: int = 16) -> DataFrame:
    """(query, id, layer, similarity, rank): the first layer with a hit of exact, path suffix, partial name and edit distance.

    Exact and suffix layers are equi-joins on the name's parts; the edit layer compares a query only with distinct names of
    nearly its length (at most half of it apart), by buckets of length that are spread over ``spread`` tasks each.
    """
    n = nodes.select("id", F.lower(F.element_at(F.split("id", "::|/|:"), -1)).alias("name")).distinct()
    q = queries.select("query").distinct()
    exact = q.join(n, F.col("query") == F.col("id")).select("query", "id", F.lit(1).alias("layer"), F.lit(1.0).alias("similarity"))
    suffix = q.filter(F.col("query").rlike("[/:]")).withColumn("name", F.lower(F.element_at(F.split("query", "::|/|:"), -1))).join(n, "name")
    suffix = suffix.filter(F.col("id").endswith(F.col("query")) & (F.col("id") != F.col("query"))).select("query", "id", F.lit(2).alias("layer"), F.lit(0.9).alias("similarity"))
    partial = q.withColumn("name", F.lower(F.element_at(F.split("query", "::|/|:"), -1))).join(n, "name")
    many = partial.groupBy("query").agg(F.count(F.lit(1)).alias("_n"))
    qualified = F.col("query").rlike("[./:]")
    partial = partial.join(many, "query").select("query", "id", F.lit(3).alias("layer"), F.when(F.col("_n") > 1, 0.7).when(qualified, 0.95).otherwise(0.9).alias("similarity"))
    lost = q.filter("length(query) <= 512").join(exact.select("query").unionByName(suffix.select("query")).unionByName(partial.select("query")), "query", "left_anti")
    near = lost.withColumn("len", F.explode(F.expr("sequence(cast(ceil(length(query) / 2) as int), length(query) + cast(floor(length(query) / 2) as int))"))).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    names = n.select("name").distinct().withColumn("len", F.length("name")).withColumn("_s", F.pmod(F.xxhash64("name"), F.lit(spread)).cast("int"))
    near = near.join(names, ["len", "_s"]).withColumn("similarity", F.lit(1.0) - F.levenshtein(F.lower("query"), "name") / F.greatest(F.length("query"), "len")).filter("similarity >= 0.5")
    near = near.join(n, "name").select("query", "id", F.lit(4).alias("layer"), F.least("similarity", F.lit(0.75)).alias("similarity"))
    every = exact.unionByName(suffix).unionByName(partial).unionByName(near)
    first = every.groupBy("query").agg(F.min("layer").alias("layer"))
    ranked = every.join(first, ["query", "layer"]).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id")))
    return ranked.filter(F.col("rank") <= max(1, limit)).select("query", "id", "layer", "similarity", "rank")


# --- quality and change -------------------------------------------------------------------------------------------


def bag_difference(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose numbers of occurrences differ: (keys, old_n, new_n)."""
    both = old.select(*keys, F.lit(1).alias("o"), F.lit(0).alias("w")).unionByName(new.select(*keys, F.lit(0).alias("o"), F.lit(1).alias("w")))
    return both.groupBy(*keys).agg(F.sum("o").alias("old_n"), F.sum("w").alias("new_n")).filter("old_n <> new_n")


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    """Canonical (file, symbol, kind) with more than one distinct id; a legacy # parts like ::."""
    canonical = F.regexp_replace("id", "#(?=[^#]*$)", "::")
    return nodes.select(canonical.alias("canonical"), "kind", "id").distinct().groupBy("canonical", "kind").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("id")).alias("ids")).filter("n > 1")


def contains_coverage(nodes: DataFrame, edges: DataFrame, symbols: Column) -> DataFrame:
    """One row: symbols, how many are the target of a contains edge, and their share (null without symbols)."""
    inside = edges.filter("relation = 'contains'").select(F.col("target").alias("id"), F.lit(1).alias("c")).distinct()
    out = nodes.filter(symbols).select("id").distinct().join(inside, "id", "left").agg(F.count(F.lit(1)).alias("symbols"), F.count("c").alias("covered"))
    return out.withColumn("coverage", F.when(F.col("symbols") > 0, F.col("covered") / F.col("symbols")))


def orphans(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: symbols (id, entrypoint, pure_type, test_export), those without a coupling, the exempt ones among them by the
    first reason that applies, the others' share, and whether it is 5 % or less; null share and a pass without symbols."""
    lone = symbols.join(coupling_degree(edges).select("id", F.lit(True).alias("_c")), "id", "left").withColumn("_c", F.coalesce("_c", F.lit(False)))
    reason = F.when(F.col("_c"), "coupled").when(F.col("entrypoint"), "entrypoint").when(F.col("pure_type"), "pure-type").when(F.col("test_export"), "test-export").otherwise("orphan")
    n = lambda v: F.count(F.when(reason == v, 1))
    row = lone.agg(F.count(F.lit(1)).alias("symbols"), F.count(F.when(~F.col("_c"), 1)).alias("lone"), n("entrypoint").alias("entrypoints"), n("pure-type").alias("pure_types"), n("test-export").alias("test_exports"), n("orphan").alias("orphans"))
    ratio = F.when(F.col("symbols") > 0, F.col("orphans") / F.col("symbols"))
    return row.withColumn("ratio", ratio).withColumn("passed", F.coalesce(ratio <= 0.05, F.lit(True)))


def legacy_or_ignored(nodes: DataFrame, ignored: str) -> DataFrame:
    """(id, reason) of nodes with a legacy id (file#symbol) or whose file, up to the first ::, matches the pattern ``ignored``."""
    file = F.regexp_extract("id", r"^(.*?)(?=::|$)", 1)
    reason = F.when(F.col("id").rlike("^[^#]+#[^#]+$") & ~F.col("id").contains("::"), "legacy").when(file.rlike(ignored), "ignored")
    return nodes.select("id", reason.alias("reason")).filter("reason IS NOT NULL")


def merge_incremental(old_nodes: DataFrame, old_edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): old ones of changed files (file) go, with every edge that touches them; new ones come, new ids win."""
    gone = old_nodes.join(changed, "file", "left_semi").select("id")
    kept = old_nodes.join(changed, "file", "left_anti").join(new_nodes.select("id"), "id", "left_anti")
    still = old_edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
    return kept.select(new_nodes.columns).unionByName(new_nodes), still.select(new_edges.columns).unionByName(new_edges)
