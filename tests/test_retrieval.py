import pytest
from pyspark.sql import functions as F

from orrery.functions import expressions as x
from orrery.operators import retrieval as r
from orrery.operators import statistics as s


@pytest.mark.parametrize(
    ("text", "want"),
    [("foo.bar baz", ["foo", "bar", "foobar", "baz"]), ("数据库 API", ["数", "据", "库", "数据", "据库", "API"]), ("é", []), ("", []), ("a-b_c", ["a", "b", "c", "abc"])],
)
def test_tokens(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(r.kb_tokens(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(("text", "want"), [("PQueue", ["queue"]), ("XMLParser", ["xml", "parser"]), ("priority-queue http_client", ["priority", "queue", "http", "client"]), ("a b", []), ("foo foo", ["foo"])])
def test_graph_terms(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(r.graph_terms(F.col("t"))).first()[0] == want


def test_bm25_counts_repeated_query_terms(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (3, "gamma gamma"), (4, "delta"), (5, "eps")], "chunk_id long, text string")
    index = r.postings(docs)
    stats = spark.createDataFrame([(5, 1.4)], "n long, avgdl double")
    q = spark.createDataFrame([(1, "Gamma"), (2, "gamma"), (2, "GAMMA")], "query_id long, term string")
    got = {x.query_id: x.score for x in r.bm25(index, stats, q).collect()}
    assert got[1] < 0 and got[2] == pytest.approx(2 * got[1])


def test_federation_reserves_one_of_each_source(spark):
    hits = spark.createDataFrame([(1, "vendor", i, -10.0 + i) for i in range(4)] + [(1, "project", 9, -1.0)], "query_id long, source string, chunk_id long, score double")
    got = r.federated(hits, 2).collect()
    assert {x.source for x in got} == {"vendor", "project"} and all(x.norm >= 0.999 for x in got)


def test_redaction(spark):
    text, tags = r.redact(F.col("t"))
    rows = [("see http://u:p@h/ or a@b.org in /home/me with 123456789",), ("nothing here",), ("key Zm9vYmFyMTIzNDU2Nzg5MEFC",)]
    a, b, c = spark.createDataFrame(rows, "t string").select(text.alias("t"), tags.alias("g")).collect()
    assert a.t == "see http://<credentials>@h/ or <email> in <home> with <number>" and a.g == ["url-credentials", "email", "home-path", "digits"]
    assert b.t == "nothing here" and b.g == []
    assert c.t == "key <secret>" and c.g == ["high-entropy"]


def test_chunks(spark):
    text = "intro " * 20 + "\n## First\n" + ("A sentence here. " * 200) + "\n## First\n" + "other " * 30 + "\nshort"
    got = r.chunk(spark.createDataFrame([(1, text), (2, None), (3, "x" * 9000)], "doc_id long, text string")).collect()
    ids = [c.chunk_id for c in got if c.doc_id == 1]
    assert ids[0] == "1#_1" and ids[1] == "1#first" and len(set(ids)) == len(ids)
    assert all(len(c.text) / 4 <= 420 for c in got if c.doc_id == 1)
    assert [len(c.text) for c in got if c.doc_id == 3] == [2000, 2000, 2000, 2000, 1000]


def test_pairs_of_one_table(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "id long, vec array<float>")
    got = {(p.a, p.b) for p in r.similar_pairs(v, v, 0.75).collect()}
    assert got == {(1, 2), (2, 1)}
    assert spark.range(1).select(r.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))).first()[0] == 0.0


@pytest.mark.parametrize(("version", "want"), [("v1.2.3", (1, 2, 3)), ("2", (2, 0, 0)), ("1.10-beta", (1, 10, 0)), ("next", None)])
def test_versions(spark, version, want):
    got = spark.createDataFrame([(version,)], "v string").select(x.version_key(F.col("v"))).first()[0]
    assert (tuple(got) if got else None) == want


def test_wilson_and_freshness(spark):
    low, high = s.wilson(F.lit(8.0), F.lit(10.0))
    got = spark.range(1).select(low, high, x.freshness(F.lit(30.0)), x.freshness(F.lit(30.5)), x.freshness(F.lit(90.5))).first()
    assert (round(got[0], 4), round(got[1], 4)) == (0.4902, 0.9433) and tuple(got[2:]) == ("fresh", "aging", "stale")


def test_bootstrap_is_repeatable(spark):
    values = spark.range(500).select("id", (F.col("id") % 37).cast("double").alias("v"))
    one, two = s.bootstrap_median(values, "v").first(), s.bootstrap_median(values, "v").first()
    assert one == two and one.low <= 18 <= one.high


def test_arbitration_needs_a_conflict(spark):
    rows = [("a", 1, "f(x)", 1.0, None, 0.9), ("a", 2, "f(y)", 0.5, 1.0, 0.5), ("b", 1, "g()", 1.0, 1.0, 1.0), ("b", 2, "g()", 0.0, 0.0, 0.0)]
    got = r.arbitrate(spark.createDataFrame(rows, "entity_id string, candidate long, signature string, version double, recency double, confidence double")).collect()
    assert {(c.entity_id, c.candidate, c.recommended) for c in got} == {("a", 1, True), ("a", 2, False)}


def test_bags_are_the_tokens_in_another_order(spark):
    import random

    rnd = random.Random(2)
    rows = [("".join(rnd.choice(["a", "B", "7", ".", "-", "_", "@", "é", " ", "\n", "数", "据库", "/", "(", "Foo", "İ"]) for _ in range(rnd.randint(0, 40))),) for _ in range(300)] + [(None,)]
    got = spark.createDataFrame(rows, "t string").select(F.array_sort(r.kb_tokens(F.col("t"))).alias("a"), F.array_sort(r.token_bag(F.col("t"))).alias("b"), F.array_sort(r.token_bag(F.col("t"), lower=True)).alias("c")).collect()
    for x in got:
        assert x.a == x.b and (x.c is None or x.c == sorted(t.lower() for t in x.a))


def test_a_question_reads_its_terms_buckets(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"common w{i} w{i % 5}") for i in range(200)] + [(900, ""), (901, None)], "chunk_id long, text string")
    r.store_index(docs, str(tmp_path / "i"))
    q = spark.createDataFrame([(1, "w3"), (1, "COMMON")], "query_id long, term string")
    index = r.read_index(spark, str(tmp_path / "i"), q)
    plan = index._jdf.queryExecution().toString()
    assert "regexp" not in plan.lower() and "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]
    assert spark.read.parquet(f"{tmp_path}/i/stats").first()["n"] == 202
    stats = spark.createDataFrame([(202, 600 / 202)], "n long, avgdl double")
    direct = {(x.chunk_id, round(x.score, 9)) for x in r.bm25(r.postings(docs), stats, q).collect()}
    assert direct == {(x.chunk_id, round(x.score, 9)) for x in r.search(spark, str(tmp_path / "i"), q).collect()}


def test_stored_tables_follow_their_inputs(spark, tmp_path):
    from orrery.functions.durable import stored

    at, made = str(tmp_path / "t"), []

    def build(path):
        made.append(path)
        spark.read.parquet(at).write.parquet(path)

    spark.range(3).write.parquet(at)
    one = stored(spark, "x", [at], build)
    assert stored(spark, "x", [at], build) == one and len(made) == 1
    spark.range(5).write.mode("overwrite").parquet(at)
    two = stored(spark, "x", [at], build)
    assert two != one and spark.read.parquet(two).count() == 5 and not (tmp_path / one.removeprefix("file:")).exists()


def test_pairs_of_odd_vectors_and_best_ones(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, []), (5, [None, 1.0]), (6, [0.0, 0.0]), (7, [1.0, 0.1]), (8, [1.0, 0.1]), (None, [1.0, 0.0]), (9, [2.0])], "id long, vec array<double>")
    assert {(p.a, p.b) for p in r.similar_pairs(v, v, 0.75).collect()} == {(1, 7), (1, 8), (7, 1), (8, 1), (7, 8), (8, 7), (3, 9), (9, 3)}
    best = {(p.a, p.b) for p in r.similar_pairs(v, v, 0.0, top=1, block=2).collect()}
    assert best == {(1, 7), (7, 8), (8, 7), (3, 9), (9, 3), (6, 1)}
    assert r.similar_pairs(v.limit(0), v, 0.1).collect() == []


def test_long_plain_words_are_no_secrets(spark):
    text, _ = r.redact(F.col("t"))
    got = spark.createDataFrame([("abcdefghijklmnopqrstuvwxyz and 12 x1",)], "t string").select(text).first()[0]
    assert got == "abcdefghijklmnopqrstuvwxyz and 12 x1"
