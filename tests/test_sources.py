import io
import json
import zipfile

from pyspark.sql import functions as F

from orrery.sources import files as f
from orrery.sources import sinks as k
from orrery.streaming import watch as w


def test_trees_and_markdown(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1")
    (tmp_path / "node_modules" / "b.py").write_text("y")
    (tmp_path / "src" / "doc.md").write_text("# Title\n\nsee [b](other.md)")
    got = f.scan_tree(spark, str(tmp_path)).collect()
    assert sorted((r.path.rpartition("/")[2], r.language) for r in got) == [("a.py", "python"), ("doc.md", None)]
    (doc,) = f.markdown_documents(spark, str(tmp_path)).collect()
    assert (doc.doc_id, doc.title, doc.links) == ("src/doc.md", "Title", ["other.md"])


def test_classify(spark):
    rows = [("a/readme.md", "document"), ("openapi.yaml", "api-spec"), ("x.PNG", "image"), ("a.ts", None), (".env", None), ("my-secret.md", None)]
    got = spark.createDataFrame(rows, "p string, want string").select(f.classify(F.col("p")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_html_and_office(spark):
    (row,) = f.html_to_markdown(spark.createDataFrame([("<title>T</title><nav>menu</nav><h1>H</h1><p>a<b>b</b></p><script>x</script>",)], "html string")).collect()
    assert row.title == "T" and "# H" in row.markdown and "ab" in row.markdown and "menu" not in row.markdown
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        z.writestr("word/document.xml", "<w:p ><w:t>one</w:t><w:t> two</w:t></w:p><w:p ><w:t>three</w:t></w:p>")
    got = f.office_text(spark.createDataFrame([("a.docx", blob.getvalue()), ("b.docx", b"junk")], "path string, content binary")).collect()
    assert [r.text for r in got] == ["one two\nthree", None]


def test_logs(spark, tmp_path):
    (tmp_path / "log").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    rows, bad = f.read_log(spark, str(tmp_path / "log"), "a long")
    assert sorted(r.a for r in rows.collect()) == [1, 2] and bad.first().invalid == 1


def test_graph_json_and_sinks(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "/x", "kind": "module", "label": "x", "metadata": {}}, {"id": "b", "kind": "k", "label": "b"}], "links": [{"source": "b", "target": "/x", "relation": "calls", "confidence": "EXTRACTED", "confidenceScore": 0.95}]}))
    nodes, edges = f.load_graph(spark, str(tmp_path / "g.json"))
    assert edges.first().score == 0.95 and [r.id for r in f.stale_format(nodes, "/root").collect()] == ["/x"]
    at = str(tmp_path / "out")
    k.write_graph(nodes, edges, at)
    k.write_graph(nodes.filter("id = 'b'"), edges, at)  # replaces
    again, _ = k.read_graph(spark, at)
    assert [r.id for r in again.collect()] == ["b"]
    assert k.content_hash(nodes) == k.content_hash(nodes.orderBy(F.desc("id")).repartition(3)) != k.content_hash(again)
    assert k.mermaid(edges).first().line == "  b -->|calls| _x"


def test_configuration_and_manifests(spark):
    files = spark.createDataFrame([("a.toml", 'top = 1\n[db]\nhost = "h"\non = true\n# no = 1')], "path string, text string")
    assert sorted((r.key, r.type, r.value) for r in f.config_entries(files).collect()) == [("db.host", "string", "h"), ("db.on", "boolean", "true"), ("top", "number", "1")]
    docker = spark.createDataFrame([("D", "FROM a AS b\nRUN x \\\n  y\nFROM c\nCOPY --from=b . .")], "path string, text string")
    assert [(r.instruction, r.stage) for r in f.docker_instructions(docker).orderBy("at").collect()] == [("FROM", 0), ("RUN", 0), ("FROM", 1), ("COPY", 1)]
    lock = spark.createDataFrame([("l", json.dumps({"packages": {"": {"version": "1"}, "node_modules/a": {"version": "2.0.0"}}}))], "path string, text string")
    assert [(r.package, r.version) for r in f.npm_lock_versions(lock).collect()] == [("a", "2.0.0")]
    api = spark.createDataFrame([("o", json.dumps({"paths": {"/x": {"get": {"operationId": "getX"}, "post": {}}}}))], "path string, text string")
    assert sorted((r.endpoint, r.method, r.operation_id) for r in f.openapi_operations(api).collect()) == [("/x", "GET", "getX"), ("/x", "POST", None)]
    status = spark.createDataFrame([(" M a.py",), ("R  old -> new",)], "value string")
    assert [(r.status, r.path) for r in f.porcelain(status).collect()] == [("M", "a.py"), ("R", "new")]


def test_debounced_stream(spark, tmp_path):
    rows = [("r", "a.py", "2024-01-01T00:00:00"), ("r", "b.py", "2024-01-01T00:00:02"), ("r", "dist/x", "2024-01-01T00:00:03"), ("r", "c.py", "2024-01-01T00:01:00"), ("r", "z.py", "2024-01-01T02:00:00")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"root": a, "path": b, "ts": c}) for a, b, c in rows))
    stream = w.debounced(w.change_stream(spark, str(tmp_path / "in"), "root string, path string, ts string"))
    q = stream.writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.n, tuple(r["items"])) for r in spark.sql("SELECT * FROM bursts").collect())
    assert got == [(1, ("c.py",)), (2, ("a.py", "b.py"))]


def test_graph_kept_by_micro_batches(spark, tmp_path):
    at = str(tmp_path / "graph")
    n = lambda rows: spark.createDataFrame(rows, "id string, file string")
    e = lambda rows: spark.createDataFrame(rows, "source string, target string, relation string")
    k.write_graph(n([("a", "fa"), ("b", "fb")]), e([("a", "b", "calls")]), at)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps({"path": "fb", "ts": "2024-01-01T00:00:00"}))
    derive = lambda changed: (n([("b2", "fb")]), e([("b2", "a", "calls")]))
    w.keep_graph(w.change_stream(spark, str(tmp_path / "in"), "path string, ts string"), at, derive, str(tmp_path / "cp")).awaitTermination()
    nodes, edges = k.read_graph(spark, at)
    assert {r.id for r in nodes.collect()} == {"a", "b2"} and [tuple(r) for r in edges.select("source", "target").collect()] == [("b2", "a")]


def test_status_of_changed_files(spark):
    diff = "diff --git a/new.py b/new.py\nnew file mode 100644\n--- /dev/null\n+++ b/new.py\n@@ -0,0 +1 @@\n+x\ndiff --git a/gone.py b/gone.py\ndeleted file mode 100644\n@@ -1 +0,0 @@\n-new file mode\ndiff --git a/m.py b/m.py\nindex 1..2\n@@ -1 +1 @@\n-a\n+new file mode 1\ndiff --git a/o.py b/p.py\nsimilarity index 100%\nrename from o.py\nrename to p.py\n"
    got = {r.path: r.status for r in f.changed_files(spark.createDataFrame([(diff,)], "value string")).collect()}
    assert got == {"new.py": "added", "gone.py": "deleted", "m.py": "modified", "p.py": "renamed"}


def test_neighbouring_roots_are_outside(spark):
    nodes = spark.createDataFrame([("/root/a", {}), ("/rootx/b", {}), ("/root", {}), ("c", {}), ("/other", {"external": "true"})], "id string, metadata map<string,string>")
    assert [r.id for r in f.stale_format(nodes, "/root/").collect()] == ["/rootx/b"]


def test_publications_change_at_once(spark, tmp_path):
    at = str(tmp_path / "p")
    rows = lambda n: spark.range(n).withColumnRenamed("id", "x")
    assert k.current(spark, at) is None
    k.publish({"a": rows(1), "b": rows(2)}, at)
    old = k.read_published(spark, at, "a")
    k.publish({"a": k.read_published(spark, at, "a").unionByName(rows(3)), "b": rows(5)}, at)
    assert (k.read_published(spark, at, "a").count(), k.read_published(spark, at, "b").count(), old.count()) == (4, 5, 1)
    (tmp_path / "p" / "v-dead" / "a").mkdir(parents=True)  # a writer that died before it named its publication
    assert k.read_published(spark, at, "a").count() == 4
    k.publish({"a": rows(7), "b": rows(7)}, at)
    assert k.read_published(spark, at, "a").count() == 7 and len(list((tmp_path / "p").glob("v-*"))) == 2 and len(list((tmp_path / "p").glob("CURRENT*"))) == 1


def test_bases_that_are_not_there(spark, tmp_path):
    from orrery.operators import knowledge

    docs = spark.createDataFrame([("a", "A", "## One\n" + "word f1(x) " * 30, ["b"])], "doc_id string, title string, text string, links array<string>")
    knowledge.publish_base(knowledge.build(docs, "1"), str(tmp_path / "kb"))
    tables, missing = knowledge.open_bases(spark, None, str(tmp_path / "kb"))
    assert missing == ["vendor"] and {r.source_kind for r in tables["chunks"].collect()} == {"project"}
    assert knowledge.open_bases(spark, None, None)[1] == ["vendor", "project"]


def test_documents_of_an_index(spark, tmp_path):
    index = f.llms_index(spark.createDataFrame([("# X\n- [One](https://h.org/a/one.md): x\n- [Two](https://h.org/two/)\n- [Again](https://h.org/a/one.md)\n- [Lost](https://h.org/lost)",)], "value string"))
    pages = spark.createDataFrame([("https://h.org/a/one.md", "text [l](two)", " "), ("https://h.org/two/", "other", "Title")], "url string, markdown string, title string")
    got = sorted(tuple(r) for r in f.documents(spark, index=index, pages=pages).collect())
    assert got == [("h.org/a/one", "Again", "text [l](two)", ["two"]), ("h.org/two", "Title", "other", [])]
    (tmp_path / "d.md").write_text("# D\ntext")
    assert [r.doc_id for r in f.documents(spark, str(tmp_path)).collect()] == ["d.md"]
    import pytest

    with pytest.raises(ValueError, match="folder"):
        f.documents(spark)


def test_artifacts(spark):
    files = spark.createDataFrame([("a.md", "# T\n## One\nsee [x](b.md) and [web](https://x)\n```\n## no\n```\n## One"), ("openapi.json", json.dumps({"info": {"title": "API"}, "paths": {"/x": {"get": {"operationId": "getX"}}}})), ("c.ts", "x"), ("openapi.yaml", "bad: ["), ("n.md", None)], "path string, text string")
    nodes, edges, seen = f.extract_artifacts(files)
    assert {(r.id, r.kind, r.label) for r in nodes.collect()} == {("a.md", "document", "T"), ("a.md#one", "section", "One"), ("openapi.json", "api-schema", "API"), ("openapi.json::GET /x", "api-endpoint", "getX"), ("openapi.yaml", "api-schema", "openapi.yaml")}
    assert {tuple(r) for r in edges.collect()} == {("a.md", "a.md#one", "contains"), ("a.md", "b.md", "references"), ("openapi.json", "openapi.json::GET /x", "contains")}
    assert f.extract_artifacts(files, seen)[0].collect() == [] and seen.count() == 3


def test_counts_locks_and_logs(spark, tmp_path):
    for name in ("a.py", "b.py", "c.ts", "d.xyz"):
        (tmp_path / name).write_text("x")
    assert {r.language: r.files for r in f.scan_counts(spark, str(tmp_path)).collect()} == {"python": 2, "typescript": 1, None: 1}
    pnpm = "packages:\n\n  /left@1.2.3:\n    x: 1\n  '@s/p@2.0.0(react@1)':\n    y: 1\n"
    yarn = '# c\n"@s/p@^2":\n  version "2.1.0"\n\nleft@1, left@^1.0:\n  version: 1.2.3\n'
    got = {tuple(r)[1:] for r in f.pnpm_lock_versions(spark.createDataFrame([("pnpm-lock.yaml", pnpm), ("x/yarn.lock", yarn), ("Cargo.lock", "z")], "path string, text string")).collect()}
    assert got == {("left", "1.2.3"), ("@s/p", "2.0.0"), ("@s/p", "2.1.0"), (None, None)}
    log = tmp_path / "log.jsonl"
    assert k.append_event(str(log), {"a": 1}) and k.append_event(str(log), {"b": "ü"}) and not k.append_event(str(log), {"c": 1}, on=False) and not k.append_event("/nowhere/x", {}) and not k.append_event(str(log), {"d": object()})
    assert [json.loads(line) for line in log.read_text().splitlines()] == [{"a": 1}, {"b": "ü"}]
    rows = spark.createDataFrame([(1, [1, 2])], "a int, b array<int>")
    paths = k.write_formats(rows, str(tmp_path / "out"))
    assert [spark.read.option("header", True).format(x.rpartition("/")[2]).load(x).count() for x in paths] == [1, 1, 1]
