import pytest
from pyspark.sql import functions as F

from orrery.operators import chunking as h
from orrery.sources import files as f


def test_sections_keep_their_lines(spark):
    text = "# Title\nintro\n## One\nfirst\n\nsecond\n### Deep\n" + "\n".join(f"line {i} " + "x" * 60 for i in range(40)) + "\n## Two\n\n## Three\n" + "y" * 5000
    lines = text.split("\n")
    got = h.section_chunks(spark.createDataFrame([("a", text), ("b", "plain\ntext"), ("c", " \n "), ("d", None)], "path string, text string"), 256).orderBy("path", "seq").collect()
    assert [(r["first"], r["last"], r.heading, r.text) for r in got if r.path == "b"] == [(1, 2, "", "plain\ntext")]
    a = [r for r in got if r.path == "a"]
    assert a[0].heading == "## One" and a[0].text == "## One\nfirst\n\nsecond" and (a[0]["first"], a[0]["last"]) == (3, 6)
    deep = [r for r in a if r.heading == "## One > ### Deep"]
    assert len(deep) > 2 and "\n".join(x for r in deep for x in r.text.split("\n")[1:]) == "\n".join(lines[7:47])
    assert all(len(r.text) <= 1024 for r in a) and {r.path for r in got} == {"a", "b"} and not [r for r in a if r.heading == "## Two"]
    assert "".join(r.text.split("\n", 1)[1] for r in a if r.heading == "## Three") == "y" * 5000


def test_long_files_are_cut_at_functions(spark):
    text = "\n".join(f"def f{i}():\n    x\n    y" for i in range(40))
    got = h.file_chunks(spark.createDataFrame([("a", text), ("b", ""), ("c", None)], "path string, text string"), 20).orderBy("path", "seq").collect()
    a = [r for r in got if r.path == "a"]
    assert "\n".join(r.text for r in a) == text and all(r.text.startswith("def ") and r["last"] - r["first"] < 20 for r in a)
    assert [s for r in a for s in r.symbols] == [f"f{i}" for i in range(40)] and [r["first"] for r in a][1:] == [r["last"] + 1 for r in a][:-1]
    flat = h.file_chunks(spark.createDataFrame([("a", "\n".join("z" for _ in range(45)))], "path string, text string"), 20).collect()
    assert sorted((r["first"], r["last"]) for r in flat) == [(1, 20), (21, 40), (41, 45)]


def test_lines_with_context(spark):
    files = spark.createDataFrame([("a", "one\r\ntwo x\nthree\nx\nfive"), ("b", "no"), ("c", None)], "path string, text string")
    got = h.find_lines(files, "x", context=1).orderBy("line").collect()
    assert [(r.line, r.text, r.before, r.after, r.total) for r in got] == [(2, "two x", ["one"], ["three"], 2), (4, "x", ["three"], ["five"], 2)]
    assert [(r.line, r.total) for r in h.find_lines(files, "^t|^x$", True, most=1).collect()] == [(2, 3)]
    for bad in ("", "x" * 201):
        with pytest.raises(ValueError, match="characters"):
            h.find_lines(files, bad)
    for bad in ("(a+)+", "(a|b)*", "((a*)b)+"):
        with pytest.raises(ValueError, match="repeats"):
            h.find_lines(files, bad, True)


def test_callers_and_dependents(spark):
    e = spark.createDataFrame([("b1", "a1"), ("c1", "b2"), ("d1", "c1"), ("a1", "b1"), ("x", "y")], "source string, target string")
    owners = spark.createDataFrame([(i, i[0]) for i in ("a1", "b1", "b2", "c1", "d1")], "id string, file string")
    assert {r.file: r.hop for r in h.expand_callers(e, owners, spark.createDataFrame([("a",)], "file string")).collect()} == {"a": 0, "b": 1, "c": 2}
    p = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("a", "c"), ("z", "y")], "source string, target string")
    assert {r.id: r.impacted_by for r in h.propagate(p, spark.createDataFrame([("a",)], "id string")).collect()} == {"b": ["a"], "c": ["a", "b"]}


def test_hyperedges(spark):
    rows = spark.createDataFrame([("h2", "Sign In", ["a", "b"]), ("h1", "sign out", ["b"]), ("h3", "other", ["a"])], "id string, label string, nodes array<string>")
    ids = lambda **k: [r.id for r in h.matching_hyperedges(rows, **k).collect()]
    assert ids(label="SIGN") == ["h1", "h2"] and ids(label="sign", node="a") == ["h2"] and ids(node="a", limit=1) == ["h2"] and ids() == ["h1", "h2", "h3"]


def test_yaml_and_skills(spark):
    text = "# c\nname: x  # why\nport: 80\ndb:\n  host: 'h'\n  on: true\n  users:\n    - ann\n    - name: bob\n      age: 3\nlist:\n- 1\n- 2\nempty:\nlast: \"a: b\"\n"
    got = {r.key: (r.type, r.value) for r in f.yaml_entries(spark.createDataFrame([("a.yaml", text), ("b.yaml", None)], "path string, text string")).collect()}
    assert got == {
        "name": ("string", "x"), "port": ("number", "80"), "db.host": ("string", "h"), "db.on": ("boolean", "true"), "db.users[0]": ("string", "ann"), "db.users[1].name": ("string", "bob"), "db.users[1].age": ("number", "3"),
        "list[0]": ("number", "1"), "list[1]": ("number", "2"), "last": ("string", "a: b"),
    }
    row = f.skill_rows(spark.createDataFrame([("s.md", "---\nname: \"do\"\ndescription: does it\n---\n# T\n## A\n## B b\n")], "path string, text string")).first()
    assert (row.name, row.description, row.sections) == ("do", "does it", ["A", "B b"])
    assert f.skill_rows(spark.createDataFrame([("s.md", "no front")], "path string, text string")).select(F.col("name")).first()[0] is None
