"""Statistics, evaluation, change and log operators applied to the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.functions import expressions as x
from orrery.operators import statistics as s

from .catalog import query
from .views import table

NOW = "2024-02-01 00:00:00"


def events(spark, d):
    return table(spark, d, "events")


@query("""SELECT o_orderpriority, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS good FROM orders GROUP BY 1""")
def pass_counts(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("good"))


@query("""WITH c AS (SELECT o_orderpriority, count(*)::DOUBLE AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::DOUBLE AS g FROM orders GROUP BY 1), p AS (SELECT *, g / n AS p FROM c)
SELECT o_orderpriority, round(greatest(0, (p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 6) AS low,
round(least(1, (p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 6) AS high FROM p""")
def wilson(spark, d):
    low, high = s.wilson(F.col("good"), F.col("n"))
    return pass_counts(spark, d).select("o_orderpriority", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 2")
def pearson(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.count(F.lit(1)).alias("n")).filter("n >= 2")


@query("SELECT l_returnflag, median(l_quantity) AS median FROM lineitem GROUP BY 1")
def median_by_group(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity)").alias("median"))


@query("""WITH a AS (SELECT l_suppkey AS g, l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), b AS (SELECT l_suppkey AS g, l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL)
SELECT coalesce(a.g, b.g) AS l_suppkey, round(sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) / sum(greatest(coalesce(a.n, 0), coalesce(b.n, 0))), 9) AS jaccard FROM a FULL JOIN b ON a.g = b.g AND a.k = b.k GROUP BY 1""")
def multiset_jaccard(spark, d):
    lines = table(spark, d, "lineitem")
    out = s.multiset_jaccard(lines.filter("l_returnflag = 'R'"), lines.filter("l_returnflag <> 'R'"), "l_partkey", "l_suppkey")
    return out.withColumn("jaccard", F.round("jaccard", 9))


@query("""WITH f AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_quantity > 25), t AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT count(*) AS n FROM f JOIN t USING (l_suppkey, l_partkey))
SELECT (SELECT count(*) FROM f) AS found, (SELECT count(*) FROM t) AS truth, n AS both, round(n / (SELECT count(*) FROM f), 3) AS precision, round(n / (SELECT count(*) FROM t), 3) AS recall FROM b""")
def precision_recall(spark, d):
    lines = table(spark, d, "lineitem")
    return s.precision_recall(lines.filter("l_quantity > 25"), lines.filter("l_returnflag = 'R'"), ["l_suppkey", "l_partkey"])


@query()
def bootstrap_ci(spark, d):
    return s.bootstrap_median(events(spark, d).select("event_id", "value"), "value")


@query("""SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_event(spark, d):
    return s.latest(events(spark, d), ["user_id", "event_type"], "ts", "event_id").select("event_id", "user_id", "event_type", "value")


@query("""WITH r AS (SELECT event_type AS workflow, event_id AS run_id, CASE WHEN value < 10 THEN 'success' ELSE 'failure' END AS result, value AS duration, ts AS finished FROM events),
w AS (SELECT DISTINCT event_type AS workflow FROM events UNION SELECT 'never')
SELECT w.workflow, count(run_id) AS runs, count(CASE WHEN result = 'success' THEN 1 END) AS success, count(CASE WHEN result = 'failure' THEN 1 END) AS failure, round(avg(duration), 6) AS mean_duration, max(finished) AS last_run,
CASE WHEN count(run_id) = 0 THEN 0.0 ELSE count(CASE WHEN result = 'success' THEN 1 END) / count(run_id) END AS success_rate, CASE WHEN count(run_id) = 0 THEN 0.0 ELSE count(CASE WHEN result = 'failure' THEN 1 END) / count(run_id) END AS failure_rate
FROM w LEFT JOIN r ON r.workflow = w.workflow GROUP BY w.workflow""")
def run_metrics(spark, d):
    runs = events(spark, d).select(F.col("event_type").alias("workflow"), F.col("event_id").alias("run_id"), F.when(F.col("value") < 10, "success").otherwise("failure").alias("result"), F.col("value").alias("duration"), F.col("ts").alias("finished"))
    workflows = runs.select("workflow").distinct().unionByName(spark.createDataFrame([("never",)], "workflow string"))
    return s.run_metrics(runs, workflows).withColumn("mean_duration", F.round("mean_duration", 6))


@query("""SELECT phase, n, round(mean, 6) AS mean FROM (SELECT json_extract(props, '$.k')::INT % 10 AS phase, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1) ORDER BY round(mean, 9) DESC, phase LIMIT 5""")
def hotspots(spark, d):
    phases = events(spark, d).select((F.get_json_object("props", "$.k").cast("int") % 10).alias("phase"), "value").groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return phases.orderBy(F.desc(F.round("mean", 9)), "phase").limit(5).withColumn("mean", F.round("mean", 6))


@query("""SELECT term, count(*) AS occurrences, count(DISTINCT query) AS queries, list_sort(list(DISTINCT tool)) AS tools, min(time) AS first_seen, max(time) AS last_seen FROM (
SELECT user_id AS query, event_type AS tool, ts AS time, unnest(list_distinct(['k' || json_extract(props, '$.k')::INT, 'u' || user_id % 5])) AS term FROM events) GROUP BY term HAVING count(DISTINCT query) >= 2""")
def coverage_gap(spark, d):
    terms = F.array(F.concat(F.lit("k"), F.get_json_object("props", "$.k")), F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")))
    return s.coverage_gap(events(spark, d).select(F.col("user_id").alias("query"), F.col("event_type").alias("tool"), F.col("ts").alias("time"), terms.alias("terms")))


@query("""SELECT model, tokens, calls, round(tokens * 100 / (SELECT sum(l_linenumber) FROM lineitem), 1) AS share FROM (SELECT CASE l_linestatus WHEN 'O' THEN 'ast-only' ELSE l_linestatus END || '' AS model, sum(l_linenumber)::BIGINT AS tokens, count(*) AS calls FROM lineitem GROUP BY 1)""")
def cost_summary(spark, d):
    costs = table(spark, d, "lineitem").select(F.when(F.col("l_linestatus") == "O", "").otherwise(F.col("l_linestatus")).alias("model"), F.col("l_linenumber").cast("long").alias("tokens"))
    return s.cost_summary(costs)


@query(f"""SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN a < 30 THEN '<30' WHEN a < 90 THEN '30-90' WHEN a < 180 THEN '90-180' ELSE '>=180' END AS bucket FROM (SELECT (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 8.64e10 * 8 AS a FROM events)) GROUP BY 1""")
def age_histogram(spark, d):
    days = x.age_days(F.to_timestamp(F.lit(NOW)), F.col("ts")) * 8
    return events(spark, d).groupBy(s.age_bucket(days).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT user_id, max(ts) AS activity, CASE WHEN a > 90 THEN 'stale' WHEN a > 30 THEN 'aging' ELSE 'fresh' END AS freshness FROM (SELECT user_id, max(ts) AS ts, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(ts))) / 8.64e10 AS a FROM events GROUP BY 1) GROUP BY ALL""")
def kb_status(spark, d):
    last = events(spark, d).groupBy("user_id").agg(F.max("ts").alias("activity"))
    return last.withColumn("freshness", x.freshness(x.age_days(F.to_timestamp(F.lit(NOW)), F.col("activity"))))


@query(f"""SELECT event_type, count(*) AS n, max((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) // 86400000000) AS oldest_days, round(count(*) / (SELECT count(*) / 1000.0 FROM events), 6) AS density FROM events GROUP BY 1""")
def debt_metrics(spark, d):
    e = events(spark, d)
    total = e.agg((F.count(F.lit(1)) / 1000.0).alias("k"))
    days = F.floor(x.age_days(F.to_timestamp(F.lit(NOW)), F.col("ts"))).cast("long")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max(days).alias("oldest_days")).join(F.broadcast(total)).select("event_type", "n", "oldest_days", F.round(F.col("n") / F.col("k"), 6).alias("density"))


OLD = "SELECT p_partkey, p_name AS name, p_type AS signature, p_brand AS type_parameters FROM part WHERE p_partkey % 10 <> 1"
NEW = "SELECT p_partkey, p_name, CASE WHEN p_partkey % 10 = 2 THEN p_type || '!' ELSE p_type END, CASE WHEN p_partkey % 10 = 3 THEN NULL ELSE p_brand END FROM part WHERE p_partkey % 10 <> 4"


@query(f"""WITH o AS ({OLD}), w(p_partkey, name, signature, type_parameters) AS ({NEW}) SELECT coalesce(o.p_partkey, w.p_partkey) AS name,
CASE WHEN w.p_partkey IS NULL THEN 'removed' WHEN o.p_partkey IS NULL THEN 'added' WHEN o.signature <> w.signature THEN 'signature' ELSE 'type-parameters' END AS change,
CASE WHEN w.p_partkey IS NULL THEN 'HIGH' WHEN o.p_partkey IS NULL THEN 'LOW' ELSE 'MEDIUM' END AS severity FROM o FULL JOIN w ON o.p_partkey = w.p_partkey
WHERE o.p_partkey IS NULL OR w.p_partkey IS NULL OR o.signature <> w.signature OR o.type_parameters IS DISTINCT FROM w.type_parameters""")
def structural_diff(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey") % 10
    old = p.filter(k != 1).select(F.col("p_partkey").alias("name"), F.col("p_type").alias("signature"), F.col("p_brand").alias("type_parameters"))
    new = p.filter(k != 4).select(F.col("p_partkey").alias("name"), F.when(k == 2, F.concat("p_type", F.lit("!"))).otherwise(F.col("p_type")).alias("signature"), F.when(k != 3, F.col("p_brand")).alias("type_parameters"))
    return s.structural_diff(old, new)


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)/\*.*?\*/', '', 'g'), '//[^\n]*', '', 'g'), '\s+', '', 'g'), ';', '', 'g'), ',([\])}])', '\1', 'g') = replace(replace(text, ' ', ''), chr(10), '') AS noise FROM documents""")
def drift_noise(spark, d):
    bare = F.replace(F.replace("text", F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    return table(spark, d, "documents").select("doc_id", (s.normal_code(F.col("text")) == bare).alias("noise"))


@query("""WITH o AS (SELECT doc_id AS path, md5(text) AS hash FROM documents WHERE doc_id % 7 <> 1), w AS (SELECT doc_id AS path, md5(CASE WHEN doc_id % 5 = 0 THEN text || '.' ELSE text END) AS hash FROM documents WHERE doc_id % 7 <> 2)
SELECT coalesce(o.path, w.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN w.path IS NULL THEN 'gone' ELSE 'changed' END AS reason FROM o FULL JOIN w ON o.path = w.path WHERE o.hash IS DISTINCT FROM w.hash""")
def stale_files(spark, d):
    docs = table(spark, d, "documents")
    old = docs.filter("doc_id % 7 <> 1").select(F.col("doc_id").alias("path"), F.md5("text").alias("hash"))
    new = docs.filter("doc_id % 7 <> 2").select(F.col("doc_id").alias("path"), F.md5(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))).alias("hash"))
    return s.stale_files(old, new)


@query("""SELECT doc_id AS path, CASE WHEN doc_id % 7 = 1 THEN 'missing-spec' WHEN doc_id % 7 = 3 THEN 'metadata-missing' WHEN doc_id % 5 = 0 THEN 'skeleton-changed' WHEN doc_id % 3 = 0 THEN 'mode-changed' END AS reason FROM documents""")
def delta_plan(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.md5("text").alias("hash"), F.lit("full").alias("mode"))
    k = F.col("path")
    specs = docs.filter(k % 7 != 1).select("path", F.when(k % 7 == 3, None).when(k % 5 == 0, "old").otherwise(F.col("hash")).alias("hash"), F.when(k % 3 == 0, "fast").otherwise("full").alias("mode"))
    return s.delta_plan(specs, docs)


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS "end", count(*) AS n, list_sort(list(DISTINCT event_type)) AS items FROM n GROUP BY user_id, k""")
def sessions(spark, d):
    return s.sessions(events(spark, d), "1 hour", "user_id", "ts", "event_type")


@query("""SELECT user_id, CASE WHEN bool_or(event_type = 'error') AND max(ts) < TIMESTAMP '2024-01-30' THEN 'stale' WHEN bool_or(event_type = 'error') THEN 'dirty' WHEN bool_or(event_type = 'signup') THEN 'fresh' ELSE 'unknown-provenance' END AS verdict FROM events GROUP BY 1""")
def freshness_verdict(spark, d):
    by = events(spark, d).groupBy("user_id").agg(F.bool_or(F.col("event_type") == "error").alias("e"), F.bool_or(F.col("event_type") == "signup").alias("u"), F.max("ts").alias("t"))
    verdict = F.when(F.col("e") & (F.col("t") < "2024-01-30"), "stale").when(F.col("e"), "dirty").when(F.col("u"), "fresh").otherwise("unknown-provenance")
    return by.select("user_id", verdict.alias("verdict"))


@query("""WITH r AS (SELECT p_brand, p_type, count(*) AS n, count(CASE WHEN p_size > 25 THEN 1 END) AS good FROM part GROUP BY ALL) SELECT p_brand, """ + ", ".join(f"max(CASE WHEN p_type = '{t}' THEN good / n END) AS \"{t}\"" for t in ("ECONOMY", "PROMO", "STANDARD")) + " FROM r GROUP BY 1")
def cohort_matrix(spark, d):
    p = table(spark, d, "part").groupBy("p_brand").pivot("p_type", ["ECONOMY", "PROMO", "STANDARD"]).agg(F.avg(F.when(F.col("p_size") > 25, 1.0).otherwise(0.0)))
    return p


@query("""SELECT s_nationkey, greatest(0, least(100, 100 - 20 * count(CASE WHEN s_acctbal < 0 THEN 1 END) - 10 * count(CASE WHEN s_acctbal BETWEEN 0 AND 1000 THEN 1 END) - 5 * count(CASE WHEN s_acctbal > 9000 THEN 1 END) - 8 * 0 - 4 * 0 - 3 * count(*) - 2 * 1)) AS score FROM supplier GROUP BY 1""")
def quality_score(spark, d):
    n = lambda c: F.count(F.when(c, 1))
    b = F.col("s_acctbal")
    zero = F.lit(0)
    return table(spark, d, "supplier").groupBy("s_nationkey").agg(s.quality_score(n(b < 0), n((b >= 0) & (b <= 1000)), n(b > 9000), zero, zero, F.count(F.lit(1)), F.lit(1)).alias("score"))


DIRS = "SELECT DISTINCT 'src/n' || c_nationkey AS directory FROM customer WHERE c_nationkey % 2 = 0 UNION SELECT DISTINCT 'src/n' || c_nationkey || '/' || c_mktsegment FROM customer WHERE c_nationkey % 3 = 0 UNION SELECT 'src'"


@query(f"""WITH dirs AS ({DIRS}), f AS (SELECT 'src/n' || c_nationkey || '/' || c_mktsegment || '/' || c_custkey AS path FROM customer)
SELECT path, max_by(directory, length(directory)) AS directory FROM f JOIN dirs ON starts_with(path, directory || '/') GROUP BY path""")
def prefix_join(spark, d):
    c = table(spark, d, "customer")
    at = F.concat(F.lit("src/n"), F.col("c_nationkey").cast("string"))
    dirs = c.filter("c_nationkey % 2 = 0").select(at.alias("directory")).unionByName(c.filter("c_nationkey % 3 = 0").select(F.concat_ws("/", at, "c_mktsegment").alias("directory"))).unionByName(spark.createDataFrame([("src",)], "directory string")).distinct()
    return s.longest_prefix(c.select(F.concat_ws("/", at, "c_mktsegment", F.col("c_custkey").cast("string")).alias("path")), dirs)


@query("""SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey""")
def group_rollup_edges(spark, d):
    from .views import edges

    e = edges(spark, d).filter("relation = 'calls'")
    c = table(spark, d, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_nationkey").alias("grp"))
    return s.rolled_up(e, c.unionByName(table(spark, d, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_nationkey").alias("grp"))))


@query("""SELECT id, bin, rank FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5(id || ':7'))::INT AS rank FROM (SELECT s_suppkey AS id, CASE WHEN s_acctbal / 10000 < 0.33 THEN 'low' WHEN s_acctbal / 10000 <= 0.67 THEN 'mid' ELSE 'high' END AS bin FROM supplier)) WHERE rank <= 5""")
def stratified_split(spark, d):
    return s.stratified(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 10000).alias("rate")), "rate", 5, 7)


@query("""SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1 HAVING count(*) >= 2""")
def user_activity(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")).filter("n >= 2")


@query("""SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1""")
def last_turn(spark, d):
    rank = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, d, "conversations").withColumn("r", F.row_number().over(rank)).filter("r = 1").drop("r")
