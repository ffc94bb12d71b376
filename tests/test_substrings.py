"""Substring look-ups by runs of characters: the pairs of a comparison of all with all, without one."""

import random

from orrery.operators import knowledge as k
from orrery.operators.substrings import containing, han_postings, holding_han


def plan(df):
    return df._jdf.queryExecution().toString()


def test_all_pairs_and_no_nested_loop(spark):
    r = random.Random(1)
    word = lambda n: "".join(r.choice("abc%_é据") for _ in range(n))
    texts = [(i, word(r.randint(0, 14))) for i in range(150)] + [(150, None), (151, texts_twice := "abcabc"), (152, texts_twice)]
    asked = [(i, word(r.randint(0, 5))) for i in range(60)] + [(60, None), (61, ""), (62, "abcabc"), (63, "zzz"), (64, "abcz")]
    df = containing(spark.createDataFrame(texts, "id long, text string"), "text", spark.createDataFrame(asked, "q long, needle string"), "needle")
    assert df.columns == ["id", "text", "q", "needle"]
    assert sorted((x.id, x.q) for x in df.collect()) == sorted((i, q) for i, t in texts for q, n in asked if t is not None and n and n in t)
    assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


def test_han_postings(spark):
    chunks = spark.createDataFrame([(1, "a数据b数据库"), (2, "数 据"), (3, "plain"), (4, None)], "chunk_id long, text string")
    assert {(r.gram, r.chunk_id, r["at"]) for r in han_postings(chunks).collect()} == {("数", 1, 1), ("据", 1, 2), ("数据", 1, 1), ("库", 1, 6), ("据库", 1, 5), ("数", 2, 0), ("据", 2, 2)}
    asked = spark.createDataFrame([(1, "数据"), (2, "据"), (3, "b数"), (4, "数 据"), (5, "库x")], "query_id long, wanted string")
    df = holding_han(chunks, asked)
    assert {tuple(r) for r in df.collect()} == {(1, 1), (2, 1), (2, 2), (3, 1), (4, 2)}
    assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


def test_entities_are_met_by_key(spark):
    e = spark.createDataFrame([(1, "Value", "engine.Value", "class", None, "project"), (2, "on", "bus.on", "function", "Bus", "project"), (3, "getValue", "api.getValue", "function", None, "vendor"), (1, "Value", "engine.Value", "class", None, "project")], "entity_id long, name string, qualified string, kind string, container string, source_kind string")
    q = spark.createDataFrame([(1, " value ", None, None), (2, "the getvalue call", None, None), (3, "onx", None, None), (4, "value", "class", None), (5, "on", None, "bus"), (6, "", None, None), (7, None, None, None)], "query_id long, api string, kind string, container string")
    df = k.matched_entities(q, e)
    got = sorted((r.query_id, r.entity_id, r.match, r.distance, r["rank"]) for r in df.collect())
    assert [g[:4] for g in got] == [(1, 1, "exact", 0.0)] * 2 + [(1, 3, "fuzzy", 1.0), (2, 1, "fuzzy", 1.0), (2, 1, "fuzzy", 1.0), (2, 3, "fuzzy", 1.0), (4, 1, "exact", 0.0), (4, 1, "exact", 0.0), (5, 2, "exact", 0.0)]
    assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)
