"""Items that documents quote."""

import duckdb

from orrery.operators import retrieval as r
from orrery.plans import text_queries  # noqa: F401
from orrery.plans.catalog import ORACLE, QUERIES

ITEMS = [
    (1, "to be or not to be"), (2, "a cat"), (3, "cat"), (4, "gato y perro."), (5, "lphabetic orde"), (6, "x"), (7, "中文句子"), (8, "?!"), (9, ""), (10, None),
    (11, "no document has this one"), (12, "Ab"), (13, "é"), (14, "ought"), (15, "señor ñandú corre"), (16, " one "), (None, "cat"), (1, "second text of one"),
]
DOCS = [
    (1, "xto be or not to bey"), (2, "concatenated: a cat and a catalogue"), (3, "el gato y perro. Fin"), (4, "alphabetic order is fine"), (5, None), (6, ""), (7, "这是中文句子。"),
    (8, "what?!"), (9, "AbAbAb"), (10, "café and the señor ñandú corre"), (11, "thoughtful"), (None, "the cat"), (12, "a CAT"), (13, "this one has a second text of one"), (13, "cat"), (13, "cat"),
]


def frames(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "query_id long, text string")


def test_all_documents_that_hold_an_item(spark):
    docs, items = frames(spark)
    got = [tuple(x) for x in r.quoting(docs, items).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(q, i) for q, a in ITEMS for i, t in DOCS if a is not None and t is not None and a in t}
    assert r.quoting(docs, items.limit(0)).collect() == []


def test_recall_is_that_of_the_sql(spark, tmp_path):
    d, con = str(tmp_path), duckdb.connect()
    docs, items = frames(spark)
    docs.write.parquet(f"{d}/documents.parquet")
    items.withColumnRenamed("query_id", "item_id").write.parquet(f"{d}/benchmark.parquet")
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    got = {tuple(x) for x in QUERIES["recall_at_k"](spark, d).select("category", "queries", "hits", "recall").collect()}
    want = {(c, q, h, s) for c, q, h, s in con.sql(f"SELECT category, queries, hits, recall FROM ({ORACLE['recall_at_k']})").fetchall()}
    assert got == want
