"""Look-ups, ranking, caps and validations applied to the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.functions import expressions as x
from orrery.operators import derivation as v
from orrery.operators import graph as g
from orrery.operators import retrieval as r
from orrery.operators import statistics as s

from .catalog import query
from .views import EDGES_SQL, FLOW_SQL, NODES_SQL, edges, flow, nodes, table

GRAPH = f"WITH RECURSIVE {NODES_SQL}, {EDGES_SQL}"
FLOW = f"WITH RECURSIVE {NODES_SQL}, {FLOW_SQL}"


def nation_ids(spark, d, *more):
    return table(spark, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"), *more)


@query(f"""{GRAPH}, w AS (SELECT id FROM nodes WHERE id = 'supplier:2') SELECT id AS node, 'out' AS side, e.target AS neighbour, relation, score FROM w JOIN edges e ON e.source = id
UNION ALL SELECT id, 'in', e.source, relation, score FROM w JOIN edges e ON e.target = id""")
def node_lookup(spark, d):
    n = nodes(spark, d).filter("id = 'supplier:2'").select(F.col("id").alias("node"))
    e = edges(spark, d).filter("source = 'supplier:2' OR target = 'supplier:2'")
    out = n.join(e, F.col("source") == F.col("node")).select("node", F.lit("out").alias("side"), F.col("target").alias("neighbour"), "relation", "score")
    return out.unionByName(n.join(e, F.col("target") == F.col("node")).select("node", F.lit("in").alias("side"), F.col("source").alias("neighbour"), "relation", "score"))


@query(f"{GRAPH} SELECT relation, count(*) AS kept, (SELECT count(*) FROM edges x WHERE x.relation = e.relation) - count(*) AS dropped FROM edges e WHERE score >= 0.9 GROUP BY relation")
def confidence_filter(spark, d):
    e = edges(spark, d)
    kept = g.passing(e, least=0.9).groupBy("relation").agg(F.count(F.lit(1)).alias("kept"))
    every = e.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))
    return kept.join(every, "relation").select("relation", "kept", (F.col("n") - F.col("kept")).alias("dropped"))


@query(f"{FLOW} SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM flow WHERE source <> target")
def simple_graph(spark, d):
    return g.simple_undirected(flow(spark, d), nodes(spark, d))


@query(f"{GRAPH} SELECT source AS id, score, n FROM edges WHERE target = 'supplier:1' AND relation = 'calls' ORDER BY score DESC, n DESC, source LIMIT 10")
def top_impacted(spark, d):
    callers = edges(spark, d).filter("target = 'supplier:1' AND relation = 'calls'")
    return callers.select(F.col("source").alias("id"), "score", "n").orderBy(F.desc("score"), F.desc("n"), "id").limit(10)


@query(f"""{FLOW}, m AS (SELECT 'nation:' || n_nationkey AS id, n_regionkey AS community FROM nation) SELECT m.community, m.id, count(f.source) AS degree FROM m LEFT JOIN (SELECT source FROM flow UNION ALL SELECT target FROM flow) f ON f.source = m.id
WHERE m.community = 1 GROUP BY ALL""")
def community_lookup(spark, d):
    members = nation_ids(spark, d, F.col("n_regionkey").alias("community")).filter("community = 1")
    return g.degree_total(members, flow(spark, d)).join(members, "id").select("community", "id", "degree")


@query("""SELECT community, row_number() OVER (ORDER BY size DESC, community)::INT - 1 AS rank, size FROM (SELECT s_nationkey AS community, count(*) AS size FROM supplier GROUP BY 1) WHERE size >= 2""")
def community_ranks(spark, d):
    """Suppliers' nations as communities."""
    sizes = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("community")).agg(F.count(F.lit(1)).alias("size")).filter("size >= 2")
    return sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), "community")) - 1)  # a row for each community


CAPPED = """SELECT query_id, rank, least(length(text), 2000) AS shown FROM (SELECT *, sum(least(length(text), 2000)) OVER (PARTITION BY query_id ORDER BY rank) AS run FROM (
SELECT source AS query_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS rank FROM documents)) WHERE run <= 10000 OR rank = 1"""


@query(CAPPED)
def result_caps(spark, d):
    rank = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    rows = table(spark, d, "documents").select(F.col("source").alias("query_id"), "text", rank.alias("rank"))
    return r.cap_results(rows).select("query_id", "rank", F.length("shown").alias("shown"))


@query("""WITH h AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS o, '<<<' || source || chr(10) || replace(replace(text, '<<<', '< <<'), '>>>', '> >>') || chr(10) || '>>>' AS t FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)
SELECT lang AS query_id, left(string_agg(t, chr(10) ORDER BY o), 4000) AS block FROM h GROUP BY lang""")
def evidence_blocks(spark, d):
    """Every document as a hit of its language, whole."""
    hits = table(spark, d, "documents").filter("source IS NOT NULL").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("rank"), "text", "source")
    return v.evidence_block(hits)


@query(f"""{GRAPH}, h AS (SELECT source AS id, CASE WHEN source LIKE 'region%' THEN 'regional' ELSE 'national-group' END AS label, list(target ORDER BY target) AS members FROM edges WHERE relation = 'contains' GROUP BY source)
SELECT id, len(members) AS n FROM h WHERE len(members) >= 3 AND length(label) <= 8 AND list_has_any(members, (SELECT list(id) FROM nodes WHERE kind = 'module'))""")
def hyperedge_validation(spark, d):
    h = edges(spark, d).filter("relation = 'contains'").groupBy(F.col("source").alias("id")).agg(F.sort_array(F.collect_list("target")).alias("nodes"))
    h = h.select("id", F.when(F.col("id").startswith("region"), "regional").otherwise("national-group").alias("label"), "nodes", F.lit("containment").alias("rationale"), F.lit("EXTRACTED").alias("confidence"))
    return v.valid_hyperedges(h, nodes(spark, d).filter("kind = 'module'")).select("id", F.size("nodes").cast("long").alias("n"))


@query(f"""{FLOW}, r AS (SELECT 'nation:' || n_nationkey AS id, 'region:' || n_regionkey AS pkg FROM nation), e AS (SELECT DISTINCT a.pkg AS source, b.pkg AS target FROM flow JOIN r a ON a.id = source JOIN r b ON b.id = target WHERE a.pkg <> b.pkg)
SELECT p.pkg AS package, (SELECT count(*) FROM e WHERE e.source = p.pkg) AS depends_on, (SELECT count(*) FROM e WHERE e.target = p.pkg) AS used_by, NOT EXISTS (FROM e WHERE e.target = p.pkg) AS root, NOT EXISTS (FROM e WHERE e.source = p.pkg) AS leaf FROM (SELECT DISTINCT pkg FROM r) p""")
def cross_package(spark, d):
    members = nation_ids(spark, d, F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("grp"))
    e = s.rolled_up(flow(spark, d), members).select(F.col("a").alias("source"), F.col("b").alias("target"))
    deg = g.degree_in_out(members.select(F.col("grp").alias("id")).distinct(), e)
    return deg.select(F.col("id").alias("package"), F.col("out_degree").alias("depends_on"), F.col("in_degree").alias("used_by"), (F.col("in_degree") == 0).alias("root"), (F.col("out_degree") == 0).alias("leaf"))


@query(r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name || ': ' || p_brand), '[^\pL\pN\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g')) AS slug FROM part""")
def slugs(spark, d):
    return table(spark, d, "part").select("p_partkey", x.slug(F.concat("p_name", F.lit(": "), "p_brand")).alias("slug"))


@query("""SELECT p_type, max_by(version, (major, minor)) AS latest FROM (SELECT p_type, 'v' || p_size || '.' || p_partkey % 7 AS version, p_size AS major, p_partkey % 7 AS minor FROM part) GROUP BY p_type""")
def latest_version(spark, d):
    version = F.concat(F.lit("v"), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 7).cast("string"))
    return table(spark, d, "part").select("p_type", version.alias("version")).groupBy("p_type").agg(F.max_by("version", x.version_key(F.col("version"))).alias("latest"))


@query("""SELECT p_brand, count(*) AS n, round(avg(CASE WHEN p_size > 25 THEN 1.0 ELSE 0.0 END) - (SELECT avg(CASE WHEN p_size > 25 THEN 1.0 ELSE 0.0 END) FROM part), 6) AS delta,
avg(CASE WHEN p_size > 25 THEN 1.0 ELSE 0.0 END) - (SELECT avg(CASE WHEN p_size > 25 THEN 1.0 ELSE 0.0 END) FROM part) >= -0.05 AS passed FROM part GROUP BY 1""")
def validation_stats(spark, d):
    good = F.when(F.col("p_size") > 25, 1.0).otherwise(0.0)
    p = table(spark, d, "part")
    base = p.agg(F.avg(good).alias("base"))  # one row
    by = p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.avg(good).alias("rate")).join(F.broadcast(base))
    return by.select("p_brand", "n", F.round(F.col("rate") - F.col("base"), 6).alias("delta"), (F.col("rate") - F.col("base") >= -0.05).alias("passed"))


@query("""SELECT source, language, count(*) AS files FROM (SELECT source, CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' END AS language FROM documents) WHERE language IS NOT NULL GROUP BY ALL""")
def language_groups(spark, d):
    named = x.case(F.col("lang"), {"en": "english", "de": "german", "fr": "french"})
    return table(spark, d, "documents").select("source", named.alias("language")).filter("language IS NOT NULL").groupBy("source", "language").agg(F.count(F.lit(1)).alias("files"))


@query("""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0), p AS (SELECT q.vec_id AS query, e.vec_id AS chunk, list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) AS score
FROM q JOIN embeddings e ON e.vec_id <> q.vec_id) SELECT query, chunk, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, chunk)::INT AS rank FROM p WHERE score >= 0.25) WHERE rank <= 10""")
def rag_rerank(spark, d):
    """Queries are the rows whose id is divisible by 100; chunks at or above the threshold, ten at most."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    pairs = r.similar_pairs(e.filter("id % 100 = 0"), e, 0.25, top=10)
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc(F.round("score", 9)), "b"))
    return pairs.withColumn("rank", rank).select(F.col("a").alias("query"), F.col("b").alias("chunk"), F.round("score", 6).alias("score"), "rank")


@query("""SELECT user_id, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY GROUP BY ALL""")
def retained_log(spark, d):
    e = table(spark, d, "events")
    return e.filter(F.col("ts").cast("timestamp") >= F.to_timestamp(F.lit("2024-01-23"))).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
