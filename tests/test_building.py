import json

import pytest
from pyspark.sql import functions as F

from orrery.operators import codefacts as c
from orrery.operators import planning as p
from orrery.operators import statistics as s


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_imports_are_resolved(spark):
    files = frame(spark, [(f,) for f in ("src/a.ts", "src/b/index.ts", "src/b/c.tsx", "src/b/d.js", "lib/e.mts", "src/f.ts", "src/f/index.ts", "src/lib/deep/g.ts")], "path string")
    aliases = frame(spark, [("@app/*", "src/*"), ("@app/b/*", "src/b/*"), ("~one", "src/a.ts")], "pattern string, replacement string")
    want = {
        "./b": ("src/b/index.ts", "relative"), "./b/c.jsx": ("src/b/c.tsx", "relative"), "./b/d": ("src/b/d.js", "relative"), "../lib/e.mjs": ("lib/e.mts", "relative"), "./f": ("src/f.ts", "relative"), "./f.js": ("src/f.ts", "relative"),
        "../../up": (None, "unresolved"), "./gone": (None, "unresolved"), "./x.json": (None, "external"), "node:fs": (None, "external"), "react": (None, "external"), "@scope/x": (None, "external"), "@/x": (None, "unresolved"), "/abs": (None, "unresolved"), "": (None, "unresolved"),
        "@app/b/c": ("src/b/c.tsx", "paths-alias"), "@app/a": ("src/a.ts", "paths-alias"), "~one": ("src/a.ts", "paths-alias"), "lib/deep/g": ("src/lib/deep/g.ts", "absolute"), None: (None, "unresolved"), "Strange": (None, "unresolved"),
    }
    imports = frame(spark, [("src/main.ts", x) for x in want], "file string, specifier string")
    assert {r.specifier: (r.resolved, r.kind) for r in c.resolve_imports(imports, files, aliases, "src").collect()} == want


def test_graph_of_all_sources(spark):
    n = lambda rows: frame(spark, rows, "id string, kind string, label string, metadata map<string,string>")
    e = lambda rows: frame(spark, rows, "source string, target string, relation string, confidence string, score double, evidence string")
    docs = (n([("a", "document", "doc", {"x": "1", "y": "1"})]), e([]))
    ir = (n([("a", "module", "ir", {"y": "2"}), ("b", "module", "b", None)]), e([("a", "b", "depends-on", "INFERRED", 0.65, "first"), ("a", "b", "depends-on", "EXTRACTED", 0.95, "second"), ("b", "a", "depends-on", "INFERRED", 0.65, "back"), ("a", "ghost", "calls", "EXTRACTED", 0.95, None), ("b", "a", "contains", "EXTRACTED", 0.95, None)]))
    last = (n([("a", "component", "late", {"x": "9", "z": "3"})]), e([]))
    nodes, edges, skipped = c.build_graph({"doc_graph": docs, "architecture_ir": ir, "unified_graph": last})
    assert skipped == ["cross_reference", "extraction"]
    a = {r.id: r for r in nodes.collect()}["a"]
    assert (a.kind, a.label, a.metadata) == ("module", "ir", {"x": "1", "y": "2", "z": "3"})
    assert sorted((r.source, r.target, r.relation, r.evidence) for r in edges.collect()) == [("a", "b", "depends-on", "second"), ("b", "a", "contains", None), ("b", "a", "depends-on", "back")]
    _, edges, _ = c.build_graph({"doc_graph": docs, "architecture_ir": ir}, directed=False)
    assert sorted((r.source, r.target, r.relation, r.score, r.original_direction) for r in edges.collect()) == [("a", "b", "contains", 0.95, "b->a"), ("a", "b", "depends-on", 0.95, None)]
    with pytest.raises(ValueError, match="extraction"):
        c.build_graph({})


def test_unified_form(spark):
    n = frame(spark, [("f::x", "symbol", "x", "f", "ts", None), ("f", "module", "f", None, "ts", {"k": "v"})], "id string, kind string, label string, file string, language string, metadata map<string,string>")
    e = frame(spark, [("f", "f::x", "contains", "high", "y" * 300), ("f::x", "f", "calls", "low", None)], "source string, target string, relation string, tier string, evidence string")
    nodes, edges = c.from_unified(n, e)
    assert {r.id: (r.kind, r.metadata) for r in nodes.collect()} == {"f::x": ("component", {"unifiedKind": "symbol", "sourcePath": "f"}), "f": ("module", {"k": "v"})}
    assert {r.relation: (r.confidence, r.score, len(r.evidence or "")) for r in edges.collect()} == {"contains": ("EXTRACTED", 0.95, 200), "calls": ("AMBIGUOUS", 0.25, 0)}


def test_workspaces(spark):
    m = [("packages/a/package.json", {"name": "a", "version": "1", "dependencies": {"b": "*", "react": "1"}, "devDependencies": {"b": "*"}}), ("packages/b/package.json", {"name": "b"}), ("apps/x/y/package.json", {"name": "y"}), ("other/package.json", {"name": "o"}), ("packages/c/package.json", {})]
    packages, needs = c.workspace_packages(frame(spark, [(k, json.dumps(v)) for k, v in m], "path string, text string"), ["packages/*", "apps/*/y"])
    assert sorted((r.name, r.folder, r.grp) for r in packages.collect()) == [("a", "packages/a", "packages"), ("b", "packages/b", "packages"), ("y", "apps/x/y", "apps")]
    assert [tuple(r) for r in needs.collect()] == [("a", "b")]


def test_packing_loses_nothing(spark):
    rows = [("fits", f"f{i}", 10) for i in range(3)] + [("many", f"m{i:02}", 100) for i in range(20)] + [("big", "huge", 80_000), ("big", "medium", 40_000)] + [("big", f"s{i}", 5_000) for i in range(3)] + [("over", "o", 90_000), ("over", "p", 1)]
    got = p.packed(frame(spark, rows, "cluster string, id string, cost long")).collect()
    assert {(r.cluster, r.id) for r in got} == {(a, b) for a, b, _ in rows} and len(got) == len(rows)
    bins = {}
    for r in got:
        bins.setdefault((r.cluster, r.bin), []).append(r)
    assert all(len(b) <= 15 and (sum(r.cost for r in b) <= 85_000 or len(b) == 1) for b in bins.values())
    assert len([k for k in bins if k[0] == "fits"]) == 1 and len([k for k in bins if k[0] == "many"]) == 2 and {r.id for r in bins["big", 0]} == {"huge", "s0"}
    assert [r.id for r in got if r.oversized] == ["o"]


def test_clusters_fall_back(spark):
    m = frame(spark, [("a", "x/a"), ("b", "x/b"), ("c", "y/c")], "id string, path string")
    by = lambda x: {r.id: r.cluster for r in x.collect()}
    rows, how = p.clustered(m, frame(spark, [("a", 1), ("b", 2)], "id string, community int"))
    assert how == "community" and by(rows) == {"a": "community:1", "b": "community:2", "c": "dir:y"}
    rows, how = p.clustered(m, frame(spark, [("a", 1), ("b", 1)], "id string, community int"))
    assert how == "directory" and by(rows) == {"a": "dir:x", "b": "dir:x", "c": "dir:y"}
    assert p.clustered(m.filter("id <> 'c'"), None)[1] == "single" and p.clustered(m.withColumn("path", F.lit("z/f")), None)[1] == "single"


def test_modes():
    assert p.regeneration_mode(force=True, incremental=True) == (False, True, "full") and p.regeneration_mode() == (True, False, "default")
    assert p.regeneration_mode(incremental=False) == (False, False, "incremental-explicit") and p.regeneration_mode(False, None, True) == (True, False, "incremental-explicit")


def test_snapshots(spark, tmp_path):
    at = str(tmp_path / "s")
    rows = frame(spark, [("a", 1)], "id string, n int")
    assert p.load_snapshot(spark, at, "id string, n int") == (None, "not-found")
    p.save_snapshot(rows, at)
    got, reason = p.load_snapshot(spark, at, "id string, n int")
    assert reason == "ok" and [tuple(r) for r in got.collect()] == [("a", 1)]
    p.save_snapshot(rows, at, "2.0")
    assert p.load_snapshot(spark, at, "id string, n int") == (None, "format-stale")
    (tmp_path / "bad" / "v-1" / "snapshot").mkdir(parents=True)
    (tmp_path / "bad" / "v-1" / "snapshot" / "x.parquet").write_bytes(b"junk")
    (tmp_path / "bad" / "CURRENT").write_text("v-1")
    assert p.load_snapshot(spark, str(tmp_path / "bad"), "id string, n int") == (None, "corrupt")


def test_report_rows(spark):
    text = "# R\n\n## Surprising Connections\n\n| Source | Target | Relation | Cross | Confidence | Score |\n|---|---|---|---|---|---|\n| `a` | `b` | calls | 是 | INFERRED | 5 |\n| c | d | uses | 否 | EXTRACTED | 3 |\n| short |\n## Next\n| `x` | `y` | z | 是 | A | 1 |\n"
    got = p.report_edges(frame(spark, [(text,)], "text string")).collect()
    assert [tuple(r) for r in got] == [("a", "b", "calls", True, "INFERRED"), ("c", "d", "uses", False, "EXTRACTED")]
    assert p.report_edges(frame(spark, [("none",)], "text string")).collect() == []


def test_citations_in_order(spark):
    chunks = frame(spark, [(1, "a.md", 1, 5, "text about N", "n", "N", 0.9), (2, "a.md", 90, 95, "beyond", "n", "N", 0.8), (3, "new.md", 7, 9, "unknown file", None, None, 0.7)], "rank int, path string, first int, last int, text string, node string, label string, similarity double")
    nodes = frame(spark, [(1, "n", "N", "a.md:2-3"), (2, "m", "M", "a.md"), (3, "o", "O", None), (4, "q", "Q", "a.md:8-99")], "rank int, id string, label string, spec string")
    debts = frame(spark, [(1, "b.ts", 400, 400, "TODO")], "rank int, path string, first int, last int, text string")
    hyper = frame(spark, [(1, "r" * 300)], "rank int, rationale string")
    got = p.citations(chunks, nodes, debts, hyper, frame(spark, [("a.md", 10), ("b.ts", 3)], "path string, n int")).orderBy("place").collect()
    assert [(r.path, r["first"], r["last"]) for r in got] == [("a.md", 1, 5), ("new.md", 7, 9), ("a.md", 2, 3), ("a.md", 1, 1), ("b.ts", 400, 400), ("[graph hyperedge]", 0, 0)]
    assert got[0].excerpt == "text about N" and got[2].node == "n" and len(got[-1].excerpt) == 200


def test_question_context(spark):
    hyper = frame(spark, [("h1", "Sign in flow", ["x", "y", "z"]), ("h2", "other", ["a", "b", "c"]), ("h3", "third", ["q", "r", "s"])], "id string, label string, nodes array<string>")
    nodes = frame(spark, [("a", 1), ("b", 2), ("s", 6)], "id string, rank int")
    found, mode = p.question_context(nodes, hyper, "sign in")
    assert sorted(r.id for r in found.collect()) == ["h1", "h2"] and mode is None
    found, mode = p.question_context(nodes.limit(0), hyper, " ")
    assert found.collect() == [] and mode == "rag-only"


def test_intervals(spark):
    rows = spark.range(400).select("id", (F.col("id") % 4 == 0).cast("int").alias("v"))
    a, b = p.proportion_interval(rows, "v", "id").first(), p.proportion_interval(rows, "v", "id").first()
    assert a == b and a.samples == 400 and 0.18 < a.low < 0.25 < a.high < 0.32
    assert tuple(p.proportion_interval(rows.limit(2), "v", "id").first()) == (None, None, 2)
    same = spark.range(300).select(F.when(F.col("id") < 140, 0.0).otherwise(10.0).alias("v"))
    got = s.bootstrap_median(same, "v").first()
    assert (got.low, got.high) == (0.0, 10.0)  # equal rows that drew alike would leave no doubt about the median
    assert s.bootstrap_median(same.limit(2), "v").first().low is None


def test_reproducibility(spark):
    old, new = (frame(spark, [("a", 10.0), ("b", 10.0), ("c", 10.0), ("d", 10.0)], "field string, value double"), frame(spark, [("a", 10.0), ("b", 10.1), ("c", 10.5), ("d", 12.0)], "field string, value double"))
    t = frame(spark, [("a", True), ("b", True), ("c", False), ("d", False)], "field string, exact boolean").select("field", F.lit(5.0).alias("yellow"), F.lit(10.0).alias("red"), F.lit(False).alias("two_sided"), F.lit(False).alias("ratio"), "exact")
    assert {r.field: r.severity for r in p.baseline_diff(old, new, t, "reproducibility").collect()} == {"a": "green", "b": "red", "c": "green", "d": "red"}
