"""The supplied tables as a property graph, a knowledge base and logs. Views are declarative: scans stay prunable."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions.durable import stored
from orrery.functions.expressions import evidence_level, level_score
from orrery.operators.graph import store_adjacency


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id(kind: str, key) -> F.Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, kind, label) of regions, nations, customers, suppliers and parts."""
    parts = [("region", "r_regionkey", "package", "r_name"), ("nation", "n_nationkey", "module", "n_name"), ("customer", "c_custkey", "component", "c_name"),
             ("supplier", "s_suppkey", "service", "s_name"), ("part", "p_partkey", "api-schema", "p_name")]
    views = [table(spark, sf_dir, t).select(node_id(t, k).alias("id"), F.lit(kind).alias("kind"), F.col(label).alias("label")) for t, k, kind, label in parts]
    return reduce(DataFrame.unionByName, views)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges as they are stored once for all queries, a folder for each relation, so that filters on it prune."""
    files = [f"{sf_dir}/{t}.parquet" for t in ("nation", "customer", "supplier", "orders", "lineitem")]
    path = stored(spark, "edges", files, lambda at: store_edges(spark, sf_dir, at))
    return spark.read.parquet(path).select("source", "target", "relation", "n", "confidence", "score")


#: Lines that are counted in one task, about.
PER_TASK = 1_000_000


def store_edges(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Write the edges of each relation on their own, so that no task sorts them by relation, from as many parts as leave
    about PER_TASK lines in each: a task's memory doesn't grow with the tables."""
    parts = max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "lineitem").count() // PER_TASK))
    rows = derived_edges(spark, sf_dir, parts)
    for relation in ("contains", "calls", "references"):
        rows.filter(F.col("relation") == relation).drop("relation").write.parquet(f"{path}/relation={relation}")


def adjacent(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the stored adjacency of ``edges``."""
    files = [f"{sf_dir}/{t}.parquet" for t in ("nation", "customer", "supplier", "orders", "lineitem")]
    return stored(spark, "adjacency", files, lambda at: store_adjacency(edges(spark, sf_dir), at))


def derived_edges(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """(source, target, relation, n, confidence, score): containment, customers calling suppliers, suppliers' parts; with
    ``parts``, lines are counted in so many, which are not put together again."""
    dealt = lambda df, *keys: df.repartition(parts, *keys) if parts else df
    t = lambda name: table(spark, sf_dir, name)
    one = F.lit(3).cast("long").alias("n")
    contains = [
        t("nation").select(node_id("region", "n_regionkey").alias("source"), node_id("nation", "n_nationkey").alias("target"), F.lit("contains").alias("relation"), one),
        t("customer").select(node_id("nation", "c_nationkey").alias("source"), node_id("customer", "c_custkey").alias("target"), F.lit("contains").alias("relation"), one),
        t("supplier").select(node_id("nation", "s_nationkey").alias("source"), node_id("supplier", "s_suppkey").alias("target"), F.lit("contains").alias("relation"), one),
    ]
    lines = t("lineitem")
    bought = dealt(lines.join(t("orders"), lines.l_orderkey == F.col("o_orderkey")).select("o_custkey", "l_suppkey"), "o_custkey", "l_suppkey").groupBy("o_custkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    calls = bought.select(node_id("customer", "o_custkey").alias("source"), node_id("supplier", "l_suppkey").alias("target"), F.lit("calls").alias("relation"), "n")
    made = dealt(lines.select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    references = made.select(node_id("supplier", "l_suppkey").alias("source"), node_id("part", "l_partkey").alias("target"), F.lit("references").alias("relation"), "n")
    out = reduce(DataFrame.unionByName, [*contains, calls, references])
    return out.withColumn("confidence", evidence_level(F.col("n"))).withColumn("score", level_score(F.col("confidence")))


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow between nations as it is stored once for all queries."""
    files = [f"{sf_dir}/{t}.parquet" for t in ("customer", "supplier", "orders", "lineitem")]
    return spark.read.parquet(stored(spark, "flow", files, lambda at: derived_flow(spark, sf_dir).write.parquet(at)))


def derived_flow(spark: SparkSession, sf_dir: str, top: int = 3) -> DataFrame:
    """(source, target, relation, revenue): each customer nation's ``top`` supplier nations by revenue in cents."""
    t = lambda name: table(spark, sf_dir, name)
    cents = F.floor(F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount")) * 100).cast("long")
    by_pair = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.sum(cents).alias("c"))
    joined = by_pair.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    total = joined.groupBy("c_nationkey", "s_nationkey").agg(F.sum("c").alias("revenue"))
    rank = Window.partitionBy("c_nationkey").orderBy(F.desc("revenue"), "s_nationkey")
    best = total.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= top)
    return best.select(node_id("nation", "c_nationkey").alias("source"), node_id("nation", "s_nationkey").alias("target"), F.lit("depends-on").alias("relation"), "revenue")


#: The same views for the oracle.
NODES_SQL = """nodes AS (
SELECT 'region:' || r_regionkey AS id, 'package' AS kind, r_name AS label FROM region UNION ALL
SELECT 'nation:' || n_nationkey, 'module', n_name FROM nation UNION ALL
SELECT 'customer:' || c_custkey, 'component', c_name FROM customer UNION ALL
SELECT 'supplier:' || s_suppkey, 'service', s_name FROM supplier UNION ALL
SELECT 'part:' || p_partkey, 'api-schema', p_name FROM part)"""
EDGES_SQL = """edges AS (SELECT *, CASE confidence WHEN 'EXTRACTED' THEN 0.95::DOUBLE WHEN 'INFERRED' THEN 0.65::DOUBLE ELSE 0.25::DOUBLE END AS score FROM (
SELECT *, CASE WHEN n >= 3 THEN 'EXTRACTED' WHEN n >= 1 THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS confidence FROM (
SELECT 'region:' || n_regionkey AS source, 'nation:' || n_nationkey AS target, 'contains' AS relation, 3::BIGINT AS n FROM nation UNION ALL
SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'contains', 3 FROM customer UNION ALL
SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'contains', 3 FROM supplier UNION ALL
SELECT 'customer:' || o_custkey, 'supplier:' || l_suppkey, 'calls', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey UNION ALL
SELECT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'references', count(*) FROM lineitem GROUP BY l_suppkey, l_partkey)))"""
FLOW_SQL = """flow AS (SELECT 'nation:' || c AS source, 'nation:' || s AS target, 'depends-on' AS relation, revenue FROM (
SELECT c_nationkey AS c, s_nationkey AS s, sum(floor(l_extendedprice * (1 - l_discount) * 100)::BIGINT)::BIGINT AS revenue,
row_number() OVER (PARTITION BY c_nationkey ORDER BY sum(floor(l_extendedprice * (1 - l_discount) * 100)::BIGINT) DESC, s_nationkey) AS r
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
GROUP BY c_nationkey, s_nationkey) WHERE r <= 3)"""
