import pytest
from pyspark.sql import functions as F

from orrery.functions import texts as x
from orrery.operators import knowledge as k
from orrery.operators.retrieval import bm25, postings


def one(spark, text, col):
    return spark.createDataFrame([(text,)], "t string").select(col(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("text", "tags", "want"),
    [
        ("see https://bob:pw@host/x now", ["URL_WITH_CRED"], "see <URL_WITH_CRED> now"),
        ("get HTTP://h/p?a=1&Api_Key=9 now", ["URL_WITH_CRED"], "get <URL_WITH_CRED> now"),
        ("ask a.b@c-d.org", ["EMAIL"], "ask <EMAIL>"),
        ("user@localhost stays", [], "user@localhost stays"),
        ("sk-0123456789 ghp_0123456789 BEARER abc.def", ["TOKEN"], "<TOKEN> <TOKEN> <TOKEN>"),
        ("/Users/eve/x c:\\users\\bob\\y", ["HOME"], "<HOME>/x <HOME>\\y"),
        ("abcdefghijklmnopqrst u", ["HIGH_ENTROPY"], "<HIGH_ENTROPY> u"),
        ("１２３４５６７８", ["DIGITS"], "<DIGITS>"),
        ("1234567 a-b", [], "1234567 a-b"),
        ("", [], ""),
        (None, [], ""),
    ],
)
def test_redaction_of_queries(spark, text, tags, want):
    row = k.redact_queries(spark.createDataFrame([(text,)], "text string")).first()
    assert (row.text, row.tags) == (want, tags)


@pytest.mark.parametrize(
    ("text", "want"),
    [("a OR b OR a", ("ok", ["a", "OR", "b"], '"a" OR "OR" OR "b"')), ("  !? ", ("INVALID_QUERY", [], None)), ("foo.bar Foo", ("ok", ["foo", "bar", "foobar", "Foo"], '"foo" OR "bar" OR "foobar" OR "Foo"'))],
)
def test_sanitised(spark, text, want):
    assert tuple(one(spark, text, k.sanitised)) == want


def test_equivalence(spark):
    assert one(spark, "API api 数据", k.equivalence) == "api 数 据 数据" and one(spark, "a-b", k.index_text) == "a b ab"


def test_short_han_questions(spark):
    chunks = spark.createDataFrame([(1, "数据库"), (2, "一个数据"), (3, "other"), (4, "数")], "chunk_id long, text string")
    q = spark.createDataFrame([(1, "据库"), (2, "other"), (3, "数据库的")], "query_id long, text string")
    hits = spark.createDataFrame([(1, 2, -3.0), (2, 3, -1.0)], "query_id long, chunk_id long, score double")
    got = [(r.query_id, r.chunk_id, r.score, r["rank"]) for r in k.han_fallback(hits, chunks, q).orderBy("query_id", "rank").collect()]
    assert got == [(1, 2, -3.0, 1), (1, 1, 1.0, 2), (2, 3, -1.0, 1)]


def test_entities_of_sections(spark):
    text = "export async function foo.bar(a, b?: int, ...rest, c = 1) throws E42 or IO_ERROR not MAX_SIZE; if (x) foo.bar(z) @deprecated"
    got = {(r.name, r.kind): r for r in k.heuristic_entities(spark.createDataFrame([(1, text), (2, "deprecated since 2.0-rc f1(")], "section long, text string")).collect()}
    assert set(got) == {("E42", "error_code"), ("IO_ERROR", "error_code"), ("foo.bar", "function")}
    foo = got["foo.bar", "function"]
    assert foo.params == ["a", "b", "rest", "c"] and foo.deprecated and foo.since is None and foo.confidence == 0.5


def test_lookup_falls_back_to_documents(spark):
    queries = spark.createDataFrame([(1, "f", None, None, [])], "query_id long, api string, kind string, container string, given array<string>")
    entities = spark.createDataFrame([], "entity_id long, name string, qualified string, kind string, container string, source_kind string, chunk_id long, quote string, deprecated boolean, declared array<string>, required array<string>")
    found = spark.createDataFrame([(1, 7, 1), (1, 8, 6)], "query_id long, chunk_id long, rank int")
    assert [tuple(r) for r in k.api_lookup(queries, entities, found, found).collect()] == [(1, "document_fallback", 7, 1)]
    with pytest.raises(ValueError, match="source"):
        k.of_source(found, "both")


def test_build(spark):
    docs = spark.createDataFrame([("a", "A", "# A\n\n## One\n" + "word fx(a) " * 30, ["b", "b", "ghost"]), ("b", "B", "## Two\n" + "other E42 " * 30, None)], "doc_id string, title string, text string, links array<string>")
    base = k.build(docs, "1.0")
    assert [tuple(r) for r in base["references"].collect()] == [("a", "b", "references")]
    assert {r.name for r in base["entities"].collect()} == {"fx", "E42"}
    stats = spark.createDataFrame([(2, 60.0)], "n long, avgdl double")
    best = k.with_metadata(bm25(base["postings"], stats, spark.createDataFrame([(1, "E42")], "query_id long, term string")), base["meta"], "1.0").collect()
    assert [r.doc_id for r in best] == ["b"] and k.with_metadata(bm25(base["postings"], stats, spark.createDataFrame([(1, "E42")], "query_id long, term string")), base["meta"], "2.0").collect() == []


def test_records_hold_no_question(spark, tmp_path):
    rows = spark.createDataFrame([("kb_search", "mail me@x.org about FOO", 0), ("other", "x", 0), ("kb_search", None, 0)], "tool string, text string, s long").select("tool", "text", F.timestamp_seconds("s").alias("time"), F.lit("p").alias("kb"))
    k.append_records(k.no_hit_records(rows), str(tmp_path / "log"))
    k.append_records(k.no_hit_records(rows), str(tmp_path / "log"))
    got = spark.read.json(str(tmp_path / "log")).collect()
    assert len(got) == 2 and got[0].terms == ["mail", "EMAIL", "about", "FOO"]
    assert got[0].tags == ["EMAIL"] and str(got[0].date) == "19700101"


def test_front_matter_and_diffs(spark):
    assert one(spark, "---\na: 1\n---\nbody\n---\n", x.body) == "body\n---\n" and one(spark, "text\n---\nx\n---\n", x.body) == "text\n---\nx\n---\n"
    assert one(spark, "--- a\n+++ b\n@@ -1 @@\n ctx\n+ add x \n-gone\r\n+\n\\ No newline", x.semantic_lines) == ["add x", "gone"]
    assert one(spark, "a%b_c\\", x.like_pattern) == "a\\%b\\_c\\\\"


@pytest.mark.parametrize(("text", "want"), [("a, b(c, d), [e, {f, g}]", ["a", "b(c, d)", "[e, {f, g}]"]), ("'x, y', \"q\\\", z\", `t`", ["'x, y'", '"q\\", z"', "`t`"]), (" , ,", []), (None, None)])
def test_top_level(spark, text, want):
    assert one(spark, text, x.split_top_level) == want


def test_excerpts(spark):
    long = "start " * 50 + "NEEDLE" + " end" * 80
    at = lambda t, n: spark.createDataFrame([(t, n)], "t string, n string").select(x.excerpt(F.col("t"), F.col("n"))).first()[0]
    got = at(long, "NEEDLE")
    first = long.index("NEEDLE") - 100
    assert got == ("..." + long[first : first + 206] + "...")[:200]
    assert at("short NEEDLE", "NEEDLE") == "short NEEDLE" and at("  ", "x") == "" and at("a" * 300, "x") == "a" * 197 + "..."
    text = "intro\n## Heading with words\n" + "x" * 90 + " NEEDLE " + "y" * 300
    assert at(text, "NEEDLE").startswith("## Heading with words\nxxx")


def test_cuts_and_bytes(spark):
    cut = lambda t: spark.createDataFrame([(t,)], "t string").select(x.natural_cut(F.col("t"), 20)).first()[0]
    assert cut("short") == "short" and cut("One sentence. And another one") == "One sentence." and cut("words without an end here") == "words without an end" and cut("x" * 30) == "x" * 20
    got = spark.createDataFrame([(b"plain",), (b"a\0b",), (b"a" * 9000 + b"\0",), (b"\x10\x01",)], "b binary").select(x.binary(F.col("b"))).collect()
    assert [r[0] for r in got] == [False, True, False, False]


def test_endpoints_and_times(spark):
    row = spark.range(1).select(
        x.url_path(F.lit("/"), F.lit(" a/ "), F.lit("//b")), x.url_path(F.lit("")), x.path_parameters(F.lit("/x/{b}/:a/{b}")), x.endpoint_tag(F.lit("/api/v1/:id"), F.lit("src/users.ts")), x.method_rank(F.lit("put")), x.method_rank(F.lit("zap")),
        x.valid_iso(F.lit("2024-02-30T00:00:00Z")), x.date_bucket(F.lit("2024-02-29T01:02:03.5Z")), x.han_share(F.lit("数据ab")),
    ).first()
    assert tuple(row) == ("/a/b", "/", ["a", "b"], "users", 2, 9, False, "2024-02-29", 0.5)


def test_redaction_looks_at_long_runs_once(spark):
    import random
    import re
    import time

    rng = random.Random(5)
    bits = ["a", "b", "Z", "9", "_", ".", "-", "+", "@", "://", ":", "/", "?", "&token=", "sk-", "ghp_", "Bearer ", "/home/", "C:\\Users\\", " ", "\n", "12345678", "q" * 9, "é", "="]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(4000)]
    texts += ["a@b.cc_d@e.ff", "a@b.cc.d@e.ff@g.hh", "1ab2cd://u:p@h x9://u:p@h", "aé://x:y@z", "http://h/?key=1&u://a:b@c d://e:f@g"]
    got = {r.i: (r.text, r.tags) for r in k.redact_queries(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()}
    for i, text in enumerate(texts):
        tags = []
        for tag, pattern in k.REDACTIONS:
            masked = re.sub(pattern, f"<{tag}>", text, flags=re.ASCII)
            tags += [tag] if re.search(pattern, text, flags=re.ASCII) else []
            text = masked
        assert got[i] == (text, tags), texts[i]
    long = "x@y u://w " + "a-" * 200_000
    began = time.time()
    assert k.redact_queries(spark.createDataFrame([(long,)], "text string")).first().text == long and time.time() - began < 20  # not the square of its length
