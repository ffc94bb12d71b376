import pytest
from pyspark.sql import functions as F

from orrery.operators import graph as g
from orrery.operators import layers, modularity


@pytest.fixture(scope="module")
def make(spark):
    def of(rows, relation="calls", score=0.95):
        return spark.createDataFrame([(a, b, relation, score) for a, b in rows], "source string, target string, relation string, score double")

    return of


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_bfs_visits_a_cycle_once(spark, make):
    got = g.bfs(make([("A", "B"), ("B", "A")]), ids(spark, "A"), 5).collect()
    assert [(r.id, r.depth) for r in got] == [("B", 1)]


def test_bfs_depths_directions_and_budget(spark, make):
    e = make([("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("x", "a")])
    down = {r.id: r.depth for r in g.bfs(e, ids(spark, "a"), 5, "downstream").collect()}
    assert down == {"b": 1, "c": 1, "d": 2}
    assert {r.id for r in g.bfs(e, ids(spark, "a"), 5, "both").collect()} == {"b", "c", "d", "x"}
    assert g.bfs(e, ids(spark, "a"), 0, "downstream").collect() == []
    assert {r.id for r in g.bfs(e, ids(spark, "a"), 5, "downstream", budget=2).collect()} == {"b", "c"}


def test_edges_without_a_score_do_not_pass(spark):
    e = spark.createDataFrame([("a", "b", "calls", None), ("a", "c", "calls", 0.65), ("a", "d", "calls", 0.25)], "source string, target string, relation string, score double")
    assert [r.target for r in g.passing(e, ["calls"]).collect()] == ["c"]


@pytest.mark.parametrize(("direct", "rest", "tier"), [(10, 0, "high"), (0, 50, "high"), (3, 0, "medium"), (0, 15, "medium"), (2, 14, "low")])
def test_risk(spark, direct, rest, tier):
    assert spark.range(1).select(g.risk(F.lit(direct), F.lit(rest))).first()[0] == tier


def test_strong_components_and_levels(spark, make):
    e = make([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("a", "a"), ("z", "a")])
    parts = layers.strongly_connected(ids(spark, *"abcdefz"), e)
    assert {r.id: (r.component, r.size) for r in parts.collect()} == {"a": ("a", 3), "b": ("a", 3), "c": ("a", 3), "d": ("d", 2), "e": ("d", 2), "f": ("f", 1), "z": ("z", 1)}
    assert {r.id: r.level for r in layers.levels(parts, e).collect()} == {"z": 0, "a": 1, "b": 1, "c": 1, "d": 2, "e": 2, "f": 0}


def test_closure(spark, make):
    got = {(r.a, r.b) for r in g.closure(make([("a", "b"), ("b", "c"), ("c", "d")])).collect()}
    assert got == {("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("b", "d"), ("a", "d")}


def test_two_cliques_and_their_bridge(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d")], "a string, b string")
    between = {(r.a, r.b): r.betweenness for r in modularity.betweenness(pairs, ids(spark, *"abcdef")).collect()}
    assert max(between, key=between.get) == ("c", "d") and between["c", "d"] == 18.0
    members = g.communities(pairs)
    edges = pairs.select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("calls").alias("relation"), F.lit("EXTRACTED").alias("confidence"))
    halves = spark.createDataFrame([(x, x in "def") for x in "abcdef"], "id string, community boolean")
    (top,) = g.surprising(edges, halves, modularity.betweenness(pairs, ids(spark, *"abcdef"))).collect()
    assert (top.source, top.target, top.across, top.surprise) == ("c", "d", True, 6.0)
    assert {r.id for r in members.collect()} == set("abcdef")


def test_node_upsert(spark):
    rows = [("n", 1, "old", "document", {"a": "1", "b": "1"}), ("n", 2, "new", "module", {"b": "2"}), ("m", 1, "m", "k", None)]
    got = {r.id: r for r in g.upsert_nodes(spark.createDataFrame(rows, "id string, rank int, label string, kind string, metadata map<string,string>")).collect()}
    assert got["n"].label == "new" and got["n"].kind == "module" and got["n"].metadata == {"a": "1", "b": "2"}
    assert got["m"].metadata is None


def test_incremental_equals_full(spark):
    """Rebuilding the changed files and their callers gives the graph of a full build; without callers, edges are lost."""
    n = lambda rows: spark.createDataFrame([(f"{f}::{x}", f) for f, x in rows], "id string, file string")
    e = lambda rows: spark.createDataFrame(rows, "source string, target string")
    old_n, old_e = n([("a", "f"), ("b", "g"), ("c", "h")]), e([("a::f", "b::g"), ("b::g", "c::h")])
    full_n, full_e = n([("a", "f"), ("b", "g"), ("b", "new"), ("c", "h")]), e([("a::f", "b::g"), ("b::new", "c::h")])
    for changed, equal in ((["b", "a"], True), (["b"], False)):
        files = spark.createDataFrame([(x,) for x in changed], "file string")
        new_n = full_n.join(files, "file", "left_semi").select("id", "file")
        new_e = full_e.filter(F.split("source", "::")[0].isin(changed))
        nodes, edges = g.merge_incremental(old_n, old_e, new_n, new_e, files)
        assert {r.id for r in nodes.collect()} == {r.id for r in full_n.collect()}
        assert ({tuple(r) for r in edges.collect()} == {tuple(r) for r in full_e.collect()}) == equal


@pytest.mark.parametrize(("symbol", "want"), [(" ./a.py::B ", "a.py::B"), ("a.py::B::c", "a.py::B.c"), ("", None), ("a::", None), ("a\x01b", None)])
def test_canonical_symbol(spark, symbol, want):
    assert spark.createDataFrame([(symbol,)], "s string").select(g.canonical_symbol(F.col("s"))).first()[0] == want


def test_fuzzy_layers(spark):
    nodes = ids(spark, "src/engine.py::Value", "src/nn.py::ReLU", "src/optim.py::ReLU")
    q = spark.createDataFrame([("src/engine.py::Value",), ("engine.py::Value",), ("relu",), ("Vlue",)], "query string")
    got = {}
    for r in g.fuzzy(q, nodes).collect():
        got.setdefault(r.query, []).append((r.layer, r.id, round(r.similarity, 2)))
    assert got["src/engine.py::Value"] == [(1, "src/engine.py::Value", 1.0)]
    assert got["engine.py::Value"] == [(2, "src/engine.py::Value", 0.9)]
    assert sorted(got["relu"]) == [(3, "src/nn.py::ReLU", 0.7), (3, "src/optim.py::ReLU", 0.7)]
    assert got["Vlue"][0][0] == 4


def test_poisoned_graphs(spark, make):
    nodes = ids(spark, "a", "b").withColumn("kind", F.lit("symbol"))
    assert g.dangling_edges(make([("a", "b"), ("a", "ghost")]), nodes).count() == 1
    twice = ids(spark, "f#x", "f::x").withColumn("kind", F.lit("symbol"))
    assert g.duplicate_ids(twice).first()["n"] == 2
    assert g.contains_coverage(nodes, make([("m", "a")], "contains"), F.lit(True)).first()["coverage"] == 0.5
    assert g.bag_difference(nodes, nodes.unionByName(nodes.limit(1)), ["id"]).first()["new_n"] == 2


def test_paths_of_any_length(spark, make):
    names = [chr(97 + i) for i in range(12)]
    e = make(list(zip(names, names[1:], strict=False)))
    assert {r.id: r.depth for r in g.path_lengths(e, ids(spark, "a"), depth=8).collect()} == {n: i for i, n in enumerate(names[:9])}
    assert g.shortest_path(e, "a", "l") == names and g.shortest_path(e, "l", "a") is None and g.shortest_path(e, "a", "a") == ["a"]
    assert g.impact(e, ids(spark, "a"), depth=8, direction="downstream").count() == 5


def test_shortest_path_takes_the_smallest_parent(spark, make):
    e = make([("s", "b"), ("s", "a"), ("a", "t"), ("b", "t"), ("t", "s")])
    assert g.shortest_path(e, "s", "t") == ["s", "a", "t"]


def test_traversal_and_its_warnings(spark, make):
    callers = [("Linear", 0.95), ("ReLU", 0.95), ("fit", 0.65), ("plot", 0.65), ("guess", 0.25)]
    e = spark.createDataFrame([(a, "Value", "calls", s) for a, s in callers] + [("Value", "X", "depends-on", 0.95), ("deep", "fit", "calls", 0.95)], "source string, target string, relation string, score double")
    at = lambda *a, **k: (lambda r: (sorted(x.id for x in r[0].collect()), r[1]))(g.traverse(e, ids(spark, "Value"), *a, **k))
    assert at(1) == (["Linear", "ReLU", "fit", "plot"], [])
    assert at(2) == (["Linear", "ReLU", "deep", "fit", "plot"], [])
    assert at(1, budget=3) == (["Linear", "ReLU", "fit"], ["budget-truncated"])
    assert at(2, budget=4) == (["Linear", "ReLU", "fit", "plot"], ["budget-truncated"]) and at(1, budget=4)[1] == []
    assert at(0) == ([], []) and at(1, least=0.99) == ([], ["confidence-filtered-all"]) and at(1, least=0.7) == (["Linear", "ReLU"], [])
    assert at(9)[1] == ["depth-clamped"]
    rows, _ = g.traverse(e, ids(spark, "Value"))
    deep = {r.id: r for r in rows.collect()}["deep"]
    assert deep.path == ["Value", "fit", "deep"] and deep.reason == "called via fit -> deep" and deep.depth == 2
    assert g.traverse(e, ids(spark, "Value"), visited=rows.select("id"))[0].collect() == []
    lost = spark.createDataFrame([("a", "b", "calls", None)], e.schema)
    got, warnings = g.traverse(lost, ids(spark, "b"))
    assert got.collect() == [] and warnings == ["missing-confidence-score"]


def test_a_hop_reads_the_frontiers_buckets(spark, make, tmp_path):
    e = make([(f"s{i}", f"t{i % 7}") for i in range(300)])
    g.store_adjacency(e, str(tmp_path / "adj"))
    hop = g.stored_hops(spark, str(tmp_path / "adj"), "upstream", ["calls"], 0.65)
    one = hop(ids(spark, "t3"))
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]
    assert one.count() == 43
    assert {r.id for r in g.bfs(hop, ids(spark, "t3"), 3).collect()} == {r.id for r in g.bfs(e, ids(spark, "t3"), 3).collect()} == {f"s{i}" for i in range(300) if i % 7 == 3}
    both = g.stored_hops(spark, str(tmp_path / "adj"), "both")
    assert {r.id for r in g.bfs(both, ids(spark, "s3"), 2, "both").collect()} == {"t3"} | {f"s{i}" for i in range(300) if i % 7 == 3} - {"s3"}
    own = ids(spark, "t3").select(g.bucket(F.col("id"), 16)).first()[0]
    for f in tmp_path.glob("adj/upstream-16/relation=calls/bucket=*/part-*"):  # what isn't needed may as well be broken
        if f.parent.name != f"bucket={own}":
            f.write_bytes(b"junk")
            (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    assert hop(ids(spark, "t3")).count() == 43


def test_upserts_keep_the_winning_row(spark):
    e = spark.createDataFrame([("a", "b", "calls", 0.65, "INFERRED", "one"), ("a", "b", "calls", 0.95, "EXTRACTED", "two"), ("b", "a", "calls", 0.25, "AMBIGUOUS", "back")], "source string, target string, relation string, score double, confidence string, evidence string")
    assert sorted(tuple(r) for r in g.upsert_edges(e).collect()) == [("a", "b", "calls", 0.95, "EXTRACTED", "two"), ("b", "a", "calls", 0.25, "AMBIGUOUS", "back")]
    assert [tuple(r) for r in g.upsert_edges(e.filter("score < 0.9 AND source = 'b'"), directed=False).collect()] == [("a", "b", "calls", 0.25, "AMBIGUOUS", "back", "b->a")]


def test_communities_by_modularity(spark):
    clique = lambda names: [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    pairs = spark.createDataFrame(clique("abcd") + clique("efghi") + [("d", "e")], "a string, b string")
    got = {r.id: r.community for r in modularity.louvain(pairs).collect()}
    assert got == dict.fromkeys("efghi", 0) | dict.fromkeys("abcd", 1)
    many = [[f"{c}{i}" for i in range(4)] for c in "klmnopq"]
    ring = [x for names in many for x in clique(names)] + [(many[i][0], many[i - 1][1]) for i in range(7)]
    by = {}
    for r in modularity.louvain(spark.createDataFrame(ring, "a string, b string")).collect():
        by.setdefault(r.community, set()).add(r.id)
    assert sorted(map(sorted, by.values())) == sorted(many)
    assert modularity.louvain(pairs.limit(0)).collect() == []


def test_surprises_of_nodes_without_a_community(spark):
    e = spark.createDataFrame([("a", "x", "calls", "INFERRED"), ("a", "b", "calls", "EXTRACTED"), ("x", "y", "calls", "EXTRACTED")], "source string, target string, relation string, confidence string")
    members = spark.createDataFrame([("a", 1), ("b", 2)], "id string, community int")
    between = spark.createDataFrame([], "a string, b string, betweenness double")
    assert [(r.source, r.target, r.across, r.surprise) for r in g.surprising(e, members, between).collect()] == [("a", "b", True, 4.0), ("a", "x", False, 2.0)]


def test_questions_find_what_they_name(spark, make):
    nodes = spark.createDataFrame([("f::PriorityQueue", "PriorityQueue"), ("f::Heap", "Heap"), ("g::else", "else")], "id string, label string")
    e = make([("f::PriorityQueue", "f::Heap"), ("g::else", "f::Heap")])
    got = [(r.id, r.depth, r.weight, r.total, r.truncated) for r in g.question_subgraph(nodes, e, "How is the priority-queue built?", budget=2, depth=1).collect()]
    assert got == [("f::PriorityQueue", 0, 3.0, 2, False), ("f::Heap", 1, 0.95, 2, False)]
    assert g.question_subgraph(nodes, e, "").collect() == []
    assert [r.truncated for r in g.question_subgraph(nodes, e, "queue", budget=1).collect()] == [True]
    assert g.sampled(nodes, 2).count() == 2
