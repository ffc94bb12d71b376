"""Imports in two phases, selections under a budget, Python imports and cohorts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orrery.operators import budgets, cohorts, ingest, pyimports
from orrery.sources.sinks import current

SCHEMA = "origin string, at int, doc_id string, title string, chunk_id string, text string, error string"
LONG = "text of the chunk that calls run(x) and stop(y) "


def rows(spark, *given):
    return spark.createDataFrame(list(given), SCHEMA)


def chunk(origin, at, doc, n, text, error=None):
    return (origin, at, doc, doc.upper(), f"{doc}#{n}", text, error)


def table(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_two_imports_and_the_same_again(spark, tmp_path):
    path = str(tmp_path / "base")
    first = rows(spark, chunk("a", 0, "d1", 0, LONG + "one"), chunk("a", 0, "d1", 1, "   short   "), chunk("b", 1, "d2", 0, LONG + "one"), chunk("b", 1, "d2", 1, LONG + "two"), chunk("c", 2, "d3", 0, LONG + "three"), chunk("c", 2, "d3", 1, None, "404"))
    plan = ingest.ingest_into(path, first)
    assert table(plan.sources, "origin", "ok", "reason") == [("a", True, None), ("b", True, None), ("c", False, "404")]
    assert table(plan.chunks, "chunk_id", "doc_id") == [("d1#0", "d1"), ("d2#1", "d2")]  # equal content once, short and failed not
    assert plan.counts.first().asDict() == {"new_documents": 2, "new_chunks": 2, "new_entities": 2, "total_chunks": 2, "total_entities": 2}
    again = ingest.ingest_into(path, first)
    assert again.counts.first().asDict() == {"new_documents": 2, "new_chunks": 0, "new_entities": 0, "total_chunks": 2, "total_entities": 2}
    plan = ingest.ingest_into(path, rows(spark, chunk("a", 0, "d1", 0, LONG.replace("stop", "halt") + "new"), chunk("z", 1, "d9", 0, LONG + "two")))
    base = ingest.open_base(spark, path)
    assert table(base["documents"], "doc_id") == [("d1",), ("d2",), ("d9",)]
    assert table(base["chunks"], "chunk_id") == [("d1#0",), ("d2#1",)] and plan.counts.first()["new_chunks"] == 1
    found = {r.entity_id: r.chunk_id for r in base["entities"].collect()}
    assert found == {"function:run": "d1#0", "function:halt": "d1#0"}  # d1's old entities went with its text


def test_a_plan_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "base")
    ingest.ingest_into(path, rows(spark, chunk("a", 0, "d1", 0, LONG)))
    before = current(spark, path)
    ingest.prepare(ingest.open_base(spark, path), rows(spark, chunk("a", 0, "d2", 0, LONG + "more")))
    assert current(spark, path) == before
    plan = ingest.ingest_into(path, rows(spark, chunk("x", 0, "d3", 0, LONG, "broken")))  # no good source: nothing is committed
    assert current(spark, path) == before and plan.counts.first()["new_documents"] == 0


def test_an_unreadable_base_is_not_replaced(spark, tmp_path):
    path = str(tmp_path / "base")
    ingest.ingest_into(path, rows(spark, chunk("a", 0, "d1", 0, LONG)))
    before = current(spark, path)
    for part in (tmp_path / "base").glob("v-*/chunks/part-*.parquet"):
        part.write_bytes(b"junk")
        (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="can't be read"):
        ingest.ingest_into(path, rows(spark, chunk("a", 0, "d2", 0, LONG + "more")))
    assert current(spark, path) == before and len(list((tmp_path / "base").glob("v-*"))) == 1


def test_greedy_selection(spark):
    r = random.Random(1)
    items = [(f"g{r.randrange(4)}" if r.random() < 0.9 else None, r.randrange(3), i, r.choice([None, 0, 3, 10, 40, 90]), "x") for i in range(200)]
    want = Counter()
    for grp in {i[0] for i in items}:
        spent = 0
        for _, p, i, cost, x in sorted((i for i in items if i[0] == grp), key=lambda i: i[1:3]):
            if cost is not None and spent + cost <= 200:
                spent += cost
                want[grp, p, i, cost, x, spent] += 1
    frame = spark.createDataFrame(items, "grp string, priority int, id int, cost int, note string")
    assert Counter(tuple(r) for r in budgets.fitting(frame, 200).collect()) == want
    assert budgets.fitting(frame.limit(0), 200).collect() == []


@pytest.mark.parametrize(("text", "want"), [("x" * 501, True), ("x" * 500, False), ("a\nb\n" + "x" * 501, True), ("a\nb\nc\n" + "x" * 501, False), ("", False)])
def test_minified(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(budgets.minified(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(("body", "want"), [("def f():\n    pass", True), ("def f():\n    # note\n    return None\n", True), ("def f():\n    ...", True), ("def f(): return 1", True), ("def f():\n    return 1", False), ("f() {\n  // x\n  go()\n}", False)])
def test_stubs(spark, body, want):
    assert spark.createDataFrame([(body,)], "t string").select(budgets.stub(F.col("t"))).first()[0] == want


def test_python_imports(spark):
    files = spark.createDataFrame([(p,) for p in ("pkg/__init__.py", "pkg/engine.py", "pkg/nn.py", "pkg/nn/__init__.py", "pkg/sub/__init__.py", "json.py", "top.py", "__init__.py")], "path string")
    asked = [
        ("pkg/sub/m.py", ".", "pkg/sub/__init__.py", "relative-sibling"), ("pkg/sub/m.py", "..engine", "pkg/engine.py", "relative-sibling"), ("pkg/m.py", ".nn", "pkg/nn.py", "relative-sibling"),
        ("pkg/m.py", "..top", "top.py", "relative-sibling"), ("pkg/m.py", "...top", None, "unresolved"), ("m.py", ".", "__init__.py", "relative-sibling"), ("m.py", "..top", None, "unresolved"),
        ("m.py", "pkg.engine", "pkg/engine.py", "module"), ("m.py", "pkg", "pkg/__init__.py", "package-init"), ("m.py", "json", None, "external"), ("m.py", "os.path", None, "external"), ("m.py", "torch.nn", None, "unresolved"), ("m.py", "", None, "unresolved"), ("m.py", None, None, "unresolved"),
    ]
    got = pyimports.resolve_python_imports(spark.createDataFrame([a[:2] for a in asked], "file string, specifier string"), files)
    assert Counter(map(tuple, got.collect())) == Counter(asked)


def test_cohorts(spark):
    runs = spark.createDataFrame([("a", "t1", True, 10), ("a", "t1", False, 5), ("a", "t2", None, 7), ("b", "t1", True, None), ("b", "t3", True, 30), ("c", "t4", None, None)], "cohort string, task string, passed boolean, tokens int")
    got = {r.cohort: (r.runs, r.judged, r.unjudged, r.passes, r.rate, r.tokens, r.without_tokens, r.lift, r.token_ratio) for r in cohorts.cohort_stats(runs, "a").collect()}
    assert got == {"a": (3, 2, 1, 1, 0.5, 10.0, 0, 1.0, 1.0), "b": (2, 2, 0, 2, 1.0, 30.0, 1, 2.0, 3.0), "c": (1, 0, 1, 0, None, None, 0, None, None)}
    assert {r.lift for r in cohorts.cohort_stats(runs, "none").collect()} == {None}
    assert table(cohorts.cohort_matrix(runs).fillna("-"), "task", "a", "b", "c") == [("t1", "1/2", "1/1", "-"), ("t2", "-", "-", "-"), ("t3", "-", "1/1", "-"), ("t4", "-", "-", "-")]
    with pytest.raises(ValueError, match="columns"):
        cohorts.cohort_matrix(runs, most=2)
