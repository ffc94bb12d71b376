from pyspark.sql import functions as F

from orrery.operators import derivation as v


def test_evidence_block_of_many_hits(spark):
    hits = spark.range(3000).select(F.lit("q").alias("query_id"), (3000 - F.col("id")).alias("rank"), F.when(F.col("id") % 7 < 6, "").alias("text"), F.lit("").alias("source"))
    hits = hits.unionByName(spark.createDataFrame([("none", 1, None, "s")], hits.schema))
    out = v.evidence_block(hits)
    want = "\n".join("<<<\n\n>>>" for i in range(3000) if i % 7 < 6)[:4000]
    assert {r.query_id: r.block for r in out.collect()} == {"q": want, "none": ""}
    assert "WindowGroupLimit" in out._jdf.queryExecution().toString()  # not all hits of a query in one row
