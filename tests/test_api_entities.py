"""Look-ups of API entities: no broadcast of the entities, however small their files look, and the first of those alike."""

from pyspark.sql import functions as F

from orrery.operators import knowledge as k


def test_entities_alike(spark, capsys):
    e = spark.range(300).select(F.col("id").alias("entity_id"), F.lit("Ring").alias("name"), F.lit("red.ring").alias("qualified"), F.when(F.col("id") % 2 == 0, "x").alias("kind"), F.lit(None).cast("string").alias("container"), F.lit("vendor").alias("source_kind"))
    q = spark.createDataFrame([(1, "ring", None, None), (2, "red", "x", None), (3, "none", None, None)], "query_id int, api string, kind string, container string")
    df = k.matched_entities(q, e, 5)
    got = sorted((x.query_id, x.entity_id, x.match, x.rank) for x in df.collect())
    assert got == [(1, i, "exact", i + 1) for i in range(5)] + [(2, 2 * i, "fuzzy", i + 1) for i in range(5)]
    df.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin [_e#" in plan and "BroadcastHashJoin [_e#" not in plan
