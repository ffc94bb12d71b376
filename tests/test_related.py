"""Chunks and nodes that are related by their vectors."""

import math
from collections import Counter

import duckdb
import numpy as np

from orrery.operators import retrieval as r
from orrery.plans import text_queries  # noqa: F401
from orrery.plans.catalog import ORACLE, QUERIES


def tables(spark, d):
    """Numbers that stand twice with other texts, names or vectors; null texts and names, names of no or one word."""
    rng = np.random.default_rng(5)
    texts = ["a gear. Or two", "geared", None, "nothing", "gear", "x-ring y", "see", "plate", "", "old plate"]
    docs = [(i % 9, f"{t} {i}" if t is not None else None) for i, t in enumerate(texts * 2)] + [(None, "ring")]
    parts = [(i % 7, n) for i, n in enumerate(["hot ring", "old gear", "alone", None, "big plate", "hot bolt", "odd widget", "an unseen", ""])]
    vecs = [(i % 8, [float(x) for x in np.float32(rng.normal(size=3))]) for i in range(11)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_name string").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("documents", "part", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    return con


def test_edges_are_those_of_the_sql(spark, tmp_path, monkeypatch):
    con = tables(spark, str(tmp_path))
    want = Counter((c, n, rel, round(s, 3)) for c, n, rel, s in con.sql(ORACLE["semantic_edges"]).fetchall())
    assert any(n > 1 for n in Counter(k[:2] for k in want.elements()).values()) and len({k[2] for k in want}) == 2
    for handed in (r.HANDED, 1):  # names broadcast, and dealt
        monkeypatch.setattr(r, "HANDED", handed)
        df = QUERIES["semantic_edges"](spark, str(tmp_path)).select("chunk", "node", "relation", "score")
        got = Counter((x.chunk, x.node, x.relation, round(x.score, 3)) for x in df.collect())
        assert got == want


def test_pairs_are_not_dealt_once_found(spark, tmp_path):
    tables(spark, str(tmp_path))
    plan = QUERIES["semantic_edges"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("FlatMapGroupsInPandas")]
    assert "Exchange" not in above and "Join" not in above


def test_copies_leave_a_task_some_at_a_time(monkeypatch):
    monkeypatch.setattr(r, "TOGETHER", 100)
    u, ids = np.ones((60, 1)), np.arange(60)
    sizes = [len(a) for a, _, _ in r.all_of(u, u, ids, ids, 0.5, slab=10, chunk=10)]
    assert sum(sizes) == 60 * 59 and max(sizes) <= 200


def test_names_are_looked_up_in_texts_where_they_are_read(spark):
    c = spark.createDataFrame([(1, "a ring")], "chunk long, text string")
    n = spark.createDataFrame([("ring",), ("bolt",)], "name string")
    plan = r.mentions(c, n)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and math.prod(len(x.names) for x in r.mentions(c, n).collect()) == 1
