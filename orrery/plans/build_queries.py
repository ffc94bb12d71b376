"""Code facts, graph builds, surfaces, plans and drift on the supplied tables, read as files, exports, calls and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import chunking as h
from orrery.operators import codefacts as c
from orrery.operators import knowledge as k
from orrery.operators import planning as p

from .catalog import query
from .derivation_queries import CUST, paths, skeletons
from .views import EDGES_SQL, FLOW_SQL, NODES_SQL, edges, flow, node_id, nodes, table

TEXT = lambda col: F.col(col).cast("string")


def name(prefix: str, col) -> F.Column:
    return F.concat(F.lit(prefix), col.cast("string"))


# --- calls and imports ------------------------------------------------------------------------------------------------


@query("SELECT 'n' || c_nationkey AS caller_file, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)::INT - 1 AS at, c_custkey AS line, c_name AS callee FROM customer")
def call_sites(spark, d):
    t = table(spark, d, "customer")
    files = t.groupBy(name("n", F.col("c_nationkey")).alias("file")).agg(F.array_sort(F.collect_list(F.struct(F.col("c_custkey").alias("line"), F.col("c_name").alias("callee")))).alias("call_sites"))
    return c.call_sites(files)


@query("""WITH p AS (SELECT p_partkey AS k, lower(p_type) AS folder, replace(p_name, ' ', '_') AS b FROM part),
f AS (SELECT DISTINCT 'src/' || folder || '/' || b || CASE k % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '/index.ts' ELSE '.tsx' END AS path FROM p),
i AS (SELECT k % 8 AS form, 'src/' || folder || '/main.ts' AS file, ['./' || b, '../economy/' || b || '.js', '@app/promo/' || b, 'node:fs', 'react', './x.json', '../../../' || b, 'standard/' || b][k % 8 + 1] AS specifier,
CASE k % 8 WHEN 0 THEN 'src/' || folder || '/' || b WHEN 1 THEN 'src/economy/' || b WHEN 2 THEN 'src/promo/' || b WHEN 7 THEN 'src/standard/' || b END AS loc FROM p),
r AS (SELECT *, CASE WHEN loc || '.ts' IN (SELECT path FROM f) THEN loc || '.ts' WHEN loc || '.tsx' IN (SELECT path FROM f) THEN loc || '.tsx' WHEN form <> 1 AND loc || '/index.ts' IN (SELECT path FROM f) THEN loc || '/index.ts' END AS resolved FROM i)
SELECT file, specifier, resolved, CASE WHEN resolved IS NOT NULL THEN CASE form WHEN 2 THEN 'paths-alias' WHEN 7 THEN 'absolute' ELSE 'relative' END WHEN form IN (3, 4, 5, 7) THEN 'external' WHEN form = 2 THEN 'external' ELSE 'unresolved' END AS kind FROM r""")
def import_resolution(spark, d):
    """Parts as files and imports of a project."""
    t = table(spark, d, "part")
    key, base = F.col("p_partkey"), F.replace("p_name", F.lit(" "), F.lit("_"))
    folder = F.lower("p_type")
    files = t.select(F.concat(F.lit("src/"), folder, F.lit("/"), base, F.when(key % 3 == 0, ".ts").when(key % 3 == 1, "/index.ts").otherwise(".tsx")).alias("path")).distinct()
    form = F.element_at(F.array(F.concat(F.lit("./"), base), F.concat(F.lit("../economy/"), base, F.lit(".js")), F.concat(F.lit("@app/promo/"), base), F.lit("node:fs"), F.lit("react"), F.lit("./x.json"), F.concat(F.lit("../../../"), base), F.concat(F.lit("standard/"), base)), (key % 8 + 1).cast("int"))
    imports = t.select(F.concat(F.lit("src/"), folder, F.lit("/main.ts")).alias("file"), form.alias("specifier"))
    return c.resolve_imports(imports, files, spark.createDataFrame([("@app/*", "src/*")], "pattern string, replacement string"), "src")


@query("""WITH ex AS (SELECT 'f' || s_suppkey % 10 AS file, s_suppkey AS o, 'C' || s_suppkey % 7 AS name, CASE WHEN s_suppkey % 9 = 8 THEN 're-export' WHEN s_suppkey % 3 = 0 THEN 'function' ELSE 'class' END AS kind, ['m0', 'm' || s_suppkey % 4] AS members FROM supplier),
own AS (SELECT file, name, arg_min(kind, o) AS kind, arg_min(members, o) AS members FROM ex WHERE kind <> 're-export' GROUP BY ALL),
im AS (SELECT 'f' || c_custkey % 13 AS file, 'C' || c_custkey % 7 AS alias, min('f' || c_custkey % 10) AS target, bool_or(c_custkey % 501 = 0) AS r, bool_or(c_custkey % 701 = 0) AS d, bool_or(c_custkey % 901 = 0) AS y FROM customer GROUP BY ALL),
ca AS (SELECT 'f' || l_partkey % 13 || '::go' AS source, 'f' || l_partkey % 13 AS caller_file, 'm' || l_linenumber % 5 AS callee, CASE WHEN l_suppkey % 8 < 7 THEN 'C' || l_suppkey % 8 END AS receiver, l_quantity > 10 AS sole_binding, l_quantity < 40 AS sole_import FROM lineitem)
SELECT source, target, relation, confidence, count(*) AS n FROM (SELECT ca.source, o.file || '::' || receiver || '.' || callee AS target, 'calls' AS relation, 'medium' AS confidence FROM ca
LEFT JOIN (SELECT DISTINCT file, name FROM own) h ON h.file = caller_file AND h.name = receiver LEFT JOIN im ON im.file = caller_file AND alias = receiver
JOIN own o ON o.name = receiver AND o.kind = 'class' AND o.file = CASE WHEN h.file IS NOT NULL THEN CASE WHEN sole_binding THEN caller_file END WHEN sole_import AND NOT coalesce(r, false) AND NOT coalesce(d, false) THEN im.target END AND list_contains(o.members, callee)
WHERE NOT coalesce(y, false)) GROUP BY ALL""")
def receiver_calls(spark, d):
    """Suppliers as exports, customers as imports, line items as calls."""
    s, u = F.col("s_suppkey"), F.col("c_custkey")
    exports = table(spark, d, "supplier").select(name("f", s % 10).alias("file"), s.alias("at"), name("C", s % 7).alias("name"), F.when(s % 9 == 8, "re-export").when(s % 3 == 0, "function").otherwise("class").alias("kind"), F.array(F.lit("m0"), name("m", s % 4)).alias("members"))
    imports = table(spark, d, "customer").select(name("f", u % 13).alias("file"), name("C", u % 7).alias("alias"), name("f", u % 10).alias("target"), (u % 501 == 0).alias("renamed"), (u % 701 == 0).alias("default"), (u % 901 == 0).alias("dynamic"))
    at = name("f", F.col("l_partkey") % 13)
    calls = table(spark, d, "lineitem").select(F.concat(at, F.lit("::go")).alias("source"), at.alias("caller_file"), name("m", F.col("l_linenumber") % 5).alias("callee"), F.when(F.col("l_suppkey") % 8 < 7, name("C", F.col("l_suppkey") % 8)).alias("receiver"), (F.col("l_quantity") > 10).alias("sole_binding"), (F.col("l_quantity") < 40).alias("sole_import"))
    return c.resolve_receivers(calls, exports, imports).groupBy("source", "target", "relation", "confidence").agg(F.count(F.lit(1)).alias("n"))


# --- the graph of all sources -----------------------------------------------------------------------------------------


def built(spark, d, directed):
    """Nations as documents and elements, suppliers as symbols, what they do as edges; two sources are missing."""
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    at = name("nation:", F.col("n_nationkey"))
    one = lambda a, b: F.create_map(F.lit(a), b)
    docs = n.select(at.alias("id"), F.lit("document").alias("kind"), F.col("n_name").alias("label"), F.map_concat(one("origin", F.lit("doc")), one("key", TEXT("n_nationkey"))).alias("metadata"))
    elements = n.filter("n_regionkey < 3").select(at.alias("id"), F.lit("module").alias("kind"), F.concat("n_name", F.lit("!")).alias("label"), one("origin", F.lit("ir")).alias("metadata"))
    flows = flow(spark, d).select("source", "target", "relation", F.lit("INFERRED").alias("confidence"), F.lit(0.65).alias("score"), F.lit(None).cast("string").alias("evidence"))
    within = s.select(name("nation:", F.col("s_nationkey")).alias("source"), name("supplier:", F.col("s_suppkey")).alias("target"), F.lit("contains").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.lit(0.95).alias("score"), F.lit("within").alias("evidence"))
    unified = c.from_unified(
        s.select(name("supplier:", F.col("s_suppkey")).alias("id"), F.lit("symbol").alias("kind"), F.col("s_name").alias("label"), F.concat(F.lit("s/"), TEXT("s_nationkey")).alias("file"), F.lit("x").alias("language"), F.lit(None).cast("map<string,string>").alias("metadata"))
        .unionByName(n.select(at.alias("id"), F.lit("module").alias("kind"), F.lit("late").alias("label"), F.lit("late").alias("file"), F.lit("x").alias("language"), F.lit(None).cast("map<string,string>").alias("metadata"))),
        edges(spark, d).filter("relation = 'calls'").join(table(spark, d, "customer").select(node_id("customer", "c_custkey").alias("source"), "c_nationkey"), "source")
        .select(name("nation:", F.col("c_nationkey")).alias("source"), "target", F.lit("calls").alias("relation"), F.when(F.col("n") > 1, "high").otherwise("low").alias("tier"), F.concat(F.lit("by "), "source").alias("evidence"))
        .unionByName(s.select(F.lit("ghost").alias("source"), name("supplier:", F.col("s_suppkey")).alias("target"), F.lit("calls").alias("relation"), F.lit("high").alias("tier"), F.lit("x").alias("evidence"))),
    )
    back = flows.select(F.col("target").alias("source"), F.col("source").alias("target"), "relation", F.lit("EXTRACTED").alias("confidence"), F.lit(0.95).alias("score"), F.lit("back").alias("evidence"))
    return c.build_graph({"doc_graph": (docs, within), "architecture_ir": (elements, flows.unionByName(back.filter("source < target"))), "unified_graph": unified}, directed)


@query("""SELECT 'nation:' || n_nationkey AS id, CASE WHEN n_regionkey < 3 THEN 'module' ELSE 'document' END AS kind, n_name || CASE WHEN n_regionkey < 3 THEN '!' ELSE '' END AS label, CASE WHEN n_regionkey < 3 THEN 'ir' ELSE 'doc' END AS origin, 'late' AS path, n_nationkey::VARCHAR AS key, NULL AS unified FROM nation
UNION ALL SELECT 'supplier:' || s_suppkey, 'component', s_name, NULL, 's/' || s_nationkey, NULL, 'symbol' FROM supplier""")
def graph_build_nodes(spark, d):
    nodes, _, skipped = built(spark, d, True)
    assert skipped == ["cross_reference", "extraction"]
    m = F.col("metadata")
    return nodes.select("id", "kind", "label", m["origin"].alias("origin"), m["sourcePath"].alias("path"), m["key"].alias("key"), m["unifiedKind"].alias("unified"))


@query(f"""WITH {EDGES_SQL}, {FLOW_SQL}, fl AS (SELECT source, target, relation, 'INFERRED' AS confidence, 0.65::DOUBLE AS score, NULL AS evidence FROM flow), bk AS (SELECT target AS source, source AS target, relation, 'EXTRACTED', 0.95::DOUBLE, 'back' FROM flow WHERE target < source),
al AS (FROM fl UNION ALL FROM bk UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'contains', 'EXTRACTED', 0.95, 'within' FROM supplier UNION ALL
SELECT 'nation:' || c_nationkey, target, 'calls', CASE WHEN n > 1 THEN 'EXTRACTED' ELSE 'AMBIGUOUS' END, CASE WHEN n > 1 THEN 0.95 ELSE 0.25 END, 'by ' || source FROM edges JOIN customer ON source = 'customer:' || c_custkey WHERE relation = 'calls'),
un AS (SELECT least(source, target) AS source, greatest(source, target) AS target, relation, confidence, score, evidence, source || '->' || target AS od, row_number() OVER (PARTITION BY least(source, target), greatest(source, target), relation ORDER BY score DESC, confidence DESC, evidence DESC NULLS LAST, source || '->' || target DESC) AS r FROM al)
SELECT source, target, relation, confidence, score, evidence, relation IN ('calls', 'depends-on', 'contains') AS directional, CASE WHEN relation = 'contains' THEN od END AS original_direction FROM un WHERE r = 1""")
def graph_build_edges(spark, d):
    return built(spark, d, False)[1]


@query(f"""WITH {FLOW_SQL}, a AS (SELECT source, target FROM flow), b AS (SELECT target, source FROM flow) SELECT source, target FROM a UNION SELECT * FROM b""")
def module_graph_union(spark, d):
    f = flow(spark, d)
    n = table(spark, d, "nation").select(name("nation:", F.col("n_nationkey")).alias("id"))
    _, e = c.union_module_graphs([(n, f.select("source", "target")), (n, f.select(F.col("target").alias("source"), F.col("source").alias("target")))])
    return e


@query(f"WITH {EDGES_SQL} SELECT 'supplier:' || s_suppkey AS id, source, target, relation, score FROM supplier JOIN edges ON source = 'supplier:' || s_suppkey WHERE relation = 'references'")
def semantic_lookup(spark, d):
    ids = table(spark, d, "supplier").select(name("supplier:", F.col("s_suppkey")).alias("id"))
    return c.semantic_lookup(edges(spark, d), ids)


DIRS = "CASE WHEN c_custkey % 9 = 0 THEN 'tools/' ELSE 'src/' END || 'n' || c_nationkey || '/' || c_mktsegment"


@query(f"""WITH f AS (SELECT {DIRS} AS dir, c_nationkey AS n, c_mktsegment AS s FROM customer), i AS (SELECT dir AS source, 'src/n' || n % 5 || '/' || s AS target FROM f WHERE n % 4 <> 3)
SELECT source, target, count(*) AS n FROM i WHERE source <> target GROUP BY ALL""")
def directory_edges(spark, d):
    files = paths(spark, d)
    t = table(spark, d, "customer")
    at = F.concat(F.when(F.col("c_custkey") % 9 == 0, "tools/").otherwise("src/"), name("n", F.col("c_nationkey")), F.lit("/"), "c_mktsegment")
    imports = t.select(F.concat(at, F.lit("/x.py")).alias("file"), F.when(F.col("c_nationkey") % 4 != 3, F.concat(name("src/n", F.col("c_nationkey") % 5), F.lit("/"), "c_mktsegment", F.lit("/y.py"))).alias("resolved"))
    return c.directory_graph(files, imports)[1]


@query(f"SELECT {DIRS} AS id, count(*) AS files FROM customer GROUP BY 1")
def directory_nodes(spark, d):
    return c.directory_graph(paths(spark, d), spark.createDataFrame([], "file string, resolved string"))[0]


# --- surfaces and models ----------------------------------------------------------------------------------------------


@query(r"""WITH e AS (SELECT '/' || regexp_extract(url, '^[a-z]+://[^/]*/([a-z]+)', 1) || '/{id}' AS path, CASE page_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'DELETE' ELSE 'POST' END AS method, 'p' || page_id % 4 AS p, CASE WHEN page_id % 5 = 0 THEN 't' || page_id % 10 END AS t, CASE WHEN page_id % 7 = 0 THEN 'op' || page_id END AS op, page_id AS seq FROM pages)
SELECT path, method, list_sort(list_distinct(list_append(list(p), 'id'))) AS parameters, ['200'] AS responses, CASE WHEN count(t) > 0 THEN list_sort(list(DISTINCT t) FILTER (t IS NOT NULL)) ELSE [split_part(path, '/', 2)] END AS tags, arg_min(op, seq) FILTER (op IS NOT NULL) AS operation_id, 'a.ts' AS file,
CASE method WHEN 'GET' THEN 0 WHEN 'POST' THEN 1 ELSE 4 END AS rank FROM e GROUP BY path, method""")
def api_surface(spark, d):
    key = F.col("page_id")
    e = table(spark, d, "pages").select(
        F.concat(F.lit("/"), F.regexp_extract("url", r"^[a-z]+://[^/]*/([a-z]+)", 1), F.lit("/{id}")).alias("path"), F.when(key % 3 == 0, "get").when(key % 3 == 1, "Delete").otherwise("POST").alias("method"),
        F.array(name("p", key % 4)).alias("parameters"), F.array(F.lit("200")).alias("responses"), F.when(key % 5 == 0, F.array(name("t", key % 10))).alias("tags"), F.when(key % 7 == 0, name("op", key)).alias("operation_id"), F.lit("a.ts").alias("file"), key.alias("seq"),
    )
    return c.api_surface(e)


@query(f"WITH {CUST} SELECT file, name, 'class' AS kind, 2 AS members FROM cu WHERE k % 5 <> 0")
def interface_surface(spark, d):
    return c.interface_surface(skeletons(spark, d))


@query("""SELECT DISTINCT n_name AS source, r_name AS target, 'inherits' AS relation FROM nation JOIN region ON n_regionkey = r_regionkey
UNION SELECT a.n_name, b.n_name, CASE WHEN a.n_nationkey % 2 = 0 THEN 'contains' ELSE 'has' END FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey * 3 % 25 AND b.n_name <> a.n_name""")
def data_model(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    kind = F.concat(F.when(F.col("n_nationkey") % 2 == 0, "Map<string, ").otherwise("Optional<"), name("NATION_", F.col("n_nationkey") * 3 % 25), F.lit(">"))
    fields = F.array(F.struct(F.lit("f").alias("name"), kind.alias("type")), F.struct(F.lit("g").alias("name"), F.lit("Unknown[]").alias("type")))
    entities = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.array("r_name").alias("parents"), fields.alias("fields"))
    return c.data_model(entities.unionByName(r.select(F.col("r_name").alias("name"), F.array().cast("array<string>").alias("parents"), F.array().cast("array<struct<name:string,type:string>>").alias("fields"))))


@query("SELECT p_brand AS path, count(*) AS keys, list_sort(list(DISTINCT CASE WHEN p_size > 25 THEN 'number' ELSE 'string' END)) AS types FROM part GROUP BY 1")
def config_reference(spark, d):
    return c.config_reference(table(spark, d, "part").select(F.col("p_brand").alias("path"), F.col("p_name").alias("key"), F.when(F.col("p_size") > 25, "number").otherwise("string").alias("type")))


@query(r"""WITH m AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text || ' E1' || doc_id % 9 || ' MY_ERROR', '\b(?:E\d{2,}|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*_(?:ERROR|CODE|EXCEPTION))\b')) AS name FROM documents)
SELECT name, count(*) AS sources, min('d' || doc_id) AS first FROM m GROUP BY name""")
def troubleshooting(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("section"), F.concat("text", F.lit(" E1"), (F.col("doc_id") % 9).cast("string"), F.lit(" MY_ERROR")).alias("text"), name("d", F.col("doc_id")).alias("file"))
    return c.troubleshooting(k.heuristic_entities(t.select("section", "text")), t.select("section", "file"))


@query(r"""WITH f AS (SELECT doc_id AS ref, string_split(text, chr(10)) AS l FROM documents), r AS (SELECT ref, l, ref % 3 + 1 AS a, ref % 3 + 1 + ref % 2 AS b, ref % 6 AS c, trim(regexp_replace(l[ref % 3 + 1], '\s+', ' ', 'g')) AS own FROM f),
x AS (SELECT ref, CASE WHEN c = 5 THEN 'file-not-found' WHEN c = 4 THEN 'invalid-location-format' WHEN b > len(l) THEN 'line-out-of-range' WHEN c = 3 THEN 'snippet-mismatch' END AS reason FROM r) SELECT ref, reason IS NULL AS verified, reason FROM x""")
def evidence_checks(spark, d):
    """Each document quoted by its lines; every sixth with an error of one kind."""
    docs = table(spark, d, "documents")
    key = F.col("doc_id")
    first = (key % 3 + 1).cast("int")
    location = F.when(key % 6 == 4, "line three").otherwise(F.concat(F.lit("L"), first.cast("string"), F.lit("-L"), (first + key % 2).cast("string")))
    snippet = F.when(key % 6 == 3, "no such words").otherwise(F.concat(F.lit(" "), F.coalesce(F.get(F.split("text", "\n"), first - 1), F.lit(""))))
    refs = docs.select(key.alias("ref"), F.when(key % 6 == 5, "gone").otherwise(key.cast("string")).alias("source"), location.alias("location"), snippet.alias("snippet"))
    return c.verified_evidence(refs, docs.select(key.cast("string").alias("path"), "text")).select("ref", "verified", "reason")


@query("SELECT p_brand AS service, split_part(p_name, ' ', 2) AS name, arg_max(p_type, p_partkey) AS value FROM part GROUP BY ALL")
def merged_environment(spark, d):
    return c.merged_environment(table(spark, d, "part").select(F.col("p_brand").alias("service"), F.split("p_name", " ")[1].alias("name"), F.col("p_type").alias("value"), F.col("p_partkey").alias("rank")))


@query("""WITH pr AS (SELECT n_nationkey AS profile, i AS place, ['ECONOMY', 'PROMO', 'STANDARD'][1 + (n_nationkey + i) % 3] AS kind FROM nation, range(2) t(i))
SELECT profile, row_number() OVER (PARTITION BY profile ORDER BY place, p_partkey)::INT AS place, p_partkey AS doc_id, kind FROM pr JOIN part ON p_type = kind""")
def docs_bundle(spark, d):
    kinds = F.array(*map(F.lit, ["ECONOMY", "PROMO", "STANDARD"]))
    profile = table(spark, d, "nation").select(F.col("n_nationkey").alias("profile"), F.explode(F.array(F.lit(0), F.lit(1))).alias("place")).withColumn("kind", F.element_at(kinds, (F.col("profile") + F.col("place")) % 3 + 1))
    return c.docs_bundle(profile, table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_type").alias("kind")))


# --- plans ------------------------------------------------------------------------------------------------------------


@query(f"""WITH m AS (SELECT coalesce(source, '') AS module, count(*) AS files, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS loc, (sum(ceil(length(text) / 3.8))::BIGINT + {p.INSTRUCTIONS}) AS input FROM documents GROUP BY 1)
SELECT module, files, loc, input, floor(input * 0.3 + 0.5)::BIGINT AS output, CASE WHEN input <= 100000 THEN 'continue' WHEN module LIKE '%0' THEN 'skip-large' ELSE 'cancel' END AS policy, (SELECT sum(input) FROM m)::BIGINT AS total FROM m""")
def dry_run(spark, d):
    m = p.estimates(table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("module"), TEXT("doc_id").alias("path"), "text"))
    total = p.dry_run(m).select(F.col("input").alias("total"))
    policy = p.budget_policy(F.col("input"), F.lit(100000), F.when(F.col("module").endswith("0"), "skip-large"), F.lit(0), F.lit(False))
    return m.join(F.broadcast(total)).withColumn("policy", policy)  # one row


@query(f"""WITH {EDGES_SQL} SELECT target, source, score, rank FROM (SELECT target, source, score, row_number() OVER (PARTITION BY target ORDER BY score DESC, source)::INT AS rank FROM edges WHERE relation = 'calls') WHERE rank <= 3""")
def relevant_callers(spark, d):
    return p.relevant_callers(edges(spark, d).filter("relation = 'calls'").select("target", "source", "score"), 3)


@query("SELECT event_id AS id, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) // 86400000000 AS age FROM events ORDER BY 2 DESC, 1 LIMIT 5")
def oldest_debt(spark, d):
    age = F.floor((F.unix_micros(F.to_timestamp(F.lit("2024-02-01"))) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86400000000)
    return p.oldest(table(spark, d, "events").select(F.col("event_id").alias("id"), age.cast("long").alias("age")))


@query(f"""WITH {EDGES_SQL} SELECT source AS id, count(*) AS degree FROM (SELECT source FROM edges UNION ALL SELECT target FROM edges) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def graph_highlights(spark, d):
    ends = edges(spark, d).select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return p.highlights(ends)


@query("""SELECT p_partkey AS grp, CASE WHEN n > 1 AND p_partkey % 4 <> 3 THEN 'd' || p_size || '/f' || p_partkey ELSE 'd' || p_size END || CASE WHEN p_partkey % 2 = 0 AND p_partkey % 5 <> 0 THEN '::' || p_type ELSE '' END AS key
FROM (SELECT *, count(*) OVER (PARTITION BY p_size) AS n FROM part)""")
def cache_keys(spark, d):
    key = F.col("p_partkey")
    at = name("d", F.col("p_size"))
    one = F.concat(at, F.lit("\\f"), key.cast("string"))
    groups = table(spark, d, "part").select(key.alias("grp"), at.alias("directory"), F.when(key % 4 == 3, F.array(one, one)).otherwise(F.array(one)).alias("files"), F.when(key % 5 != 0, F.col("p_type")).alias("language"), (key % 2 == 0).alias("split"))
    return p.cache_keys(groups).select("grp", "key")


@query("""SELECT o_orderkey AS module FROM orders WHERE NOT coalesce(CASE WHEN o_orderkey % 4 = 1 THEN true WHEN o_orderkey % 3 = 0 THEN o_orderstatus = 'F' END, false)""")
def resume_plan(spark, d):
    """Orders as modules: a third have a state, a quarter were done later."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("module"), "o_orderstatus")
    state = o.filter("module % 3 = 0").select("module", F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"), F.lit(None).cast("string").alias("error"))
    later = o.filter("module % 4 = 1").select("module", F.lit("completed").alias("status"), F.lit(None).cast("string").alias("error"))
    return p.remaining(o.select("module"), p.merge_state(state, later))


@query("""SELECT source AS generator, source NOT LIKE '%1' AND source NOT LIKE '%2' AS hit FROM documents WHERE source IS NOT NULL GROUP BY 1""")
def cache_plan(spark, d):
    """Sources as generators: the outputs of some are gone, the inputs of others changed."""
    t = table(spark, d, "documents").filter("source IS NOT NULL")
    inputs = t.select(F.col("source").alias("generator"), TEXT("doc_id").alias("path"), F.md5("text").alias("hash"))
    before = inputs.withColumn("hash", F.when(F.col("generator").endswith("1"), "old").otherwise(F.col("hash")))
    empty = spark.createDataFrame([], "generator string, key string, output string")
    manifest = p.cache_plan(before, empty, empty.select(F.col("output").alias("path"))).select("generator", "key", F.concat(F.lit("out/"), "generator").alias("output"))
    outputs = manifest.filter(~F.col("generator").endswith("2")).select(F.col("output").alias("path"))
    return p.cache_plan(inputs, manifest, outputs).select("generator", "hit")


@query("""SELECT p_partkey AS producer, CASE WHEN p_partkey % 7 = 1 THEN 'added' WHEN p_partkey % 7 = 2 THEN 'removed' WHEN p_partkey % 7 = 3 THEN 'unknown' WHEN p_partkey % 5 = 0 THEN 'changed' ELSE 'same' END AS verdict FROM part""")
def collector_fingerprints(spark, d):
    t, key = table(spark, d, "part"), F.col("p_partkey")
    old = t.filter(key % 7 != 1).select(key.alias("producer"), F.when(key % 7 != 3, F.md5("p_name")).alias("fingerprint"))
    new = t.filter(key % 7 != 2).select(key.alias("producer"), F.when(key % 5 == 0, "new").otherwise(F.md5("p_name")).alias("fingerprint"))
    return p.fingerprint_verdict(old, new)


@query("""SELECT c_custkey, c_custkey % 4 IN (0, 3) AS any_case, c_custkey % 4 = 0 AS exact FROM customer""")
def collector_surface(spark, d):
    key = F.col("c_custkey")
    path = F.concat(F.lit("a.b/"), "c_name", F.element_at(F.array(*map(F.lit, [".ts", ".md", "", ".TS"])), (key % 4 + 1).cast("int")))
    return table(spark, d, "customer").select("c_custkey", p.on_surface(path, [".ts", ".py"]).alias("any_case"), p.on_surface(path, [".ts", ".py"], True).alias("exact"))


@query("""SELECT event_type AS workflow, event_id AS run_id, CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE 'success' END AS result, duration FROM (SELECT *, value AS duration FROM events) WHERE event_id % 2 = 0 AND event_id % 5 <> 0""")
def workflow_runs(spark, d):
    key = F.col("event_id")
    log = table(spark, d, "events").select(F.when(key % 2 == 0, "workflow_run").otherwise("other").alias("event_type"), F.col("event_type").alias("workflow"), key.alias("run_id"), F.when(key % 3 == 0, " ").otherwise("Success ").alias("result"), F.when(key % 5 == 0, "yesterday").otherwise("2024-01-01T00:00:00Z").alias("finished"), F.col("value").alias("duration"))
    return p.workflow_runs(log).select("workflow", "run_id", "result", "duration")


# --- drift ------------------------------------------------------------------------------------------------------------

MEMBERS = """mo AS (SELECT p_brand AS parent, p_partkey AS name, p_type AS sig FROM part WHERE p_partkey % 10 <> 1 AND p_brand <> 'Brand#3'), mw AS (SELECT p_brand AS parent, p_partkey AS name, CASE WHEN p_partkey % 10 = 2 THEN p_type || '!' ELSE p_type END AS sig FROM part WHERE p_partkey % 10 <> 4 AND p_brand <> 'Brand#3'),
md AS (SELECT coalesce(o.parent, w.parent) AS parent, coalesce(o.name, w.name) AS name, CASE WHEN w.name IS NULL THEN 'removal' WHEN o.name IS NULL THEN 'addition' ELSE 'modification' END AS change FROM mo o FULL JOIN mw w ON o.parent = w.parent AND o.name = w.name WHERE o.sig IS DISTINCT FROM w.sig),
mx AS (SELECT *, CASE change WHEN 'addition' THEN 'LOW' ELSE 'MEDIUM' END AS severity FROM md)"""


def members(spark, d):
    t, key = table(spark, d, "part"), F.col("p_partkey")
    listed = lambda rows, sig: rows.groupBy(F.col("p_brand").alias("name")).agg(F.collect_list(F.struct(key.alias("name"), sig.alias("signature"))).alias("members"))
    new = listed(t.filter(key % 10 != 4), F.when(key % 10 == 2, F.concat("p_type", F.lit("!"))).otherwise(F.col("p_type")))
    return p.member_diff(listed(t.filter(key % 10 != 1), F.col("p_type")), new.withColumn("members", F.when(F.col("name") != "Brand#3", F.col("members"))))


@query(f"WITH {MEMBERS} SELECT * FROM mx")
def member_diff(spark, d):
    return members(spark, d)


@query(f"WITH {MEMBERS} SELECT count(*) AS total, 0::BIGINT AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low, count(*) FILTER (change = 'addition') AS additions, count(*) FILTER (change = 'removal') AS removals, count(*) FILTER (change = 'modification') AS modifications FROM mx")
def drift_summary(spark, d):
    return p.drift_summary(members(spark, d))


@query("""WITH v AS (SELECT s_suppkey AS field, CASE WHEN s_suppkey % 9 = 0 THEN 0 WHEN s_suppkey % 8 <> 0 THEN s_suppkey + 10 END::DOUBLE AS o, CASE WHEN s_suppkey % 18 = 0 THEN 0 WHEN s_suppkey % 7 <> 0 THEN s_suppkey + 10 + (s_suppkey * 7) % 23 - 11 END::DOUBLE AS w, s_suppkey % 3 = 0 AS ratio, s_suppkey % 3 = 1 AS two FROM supplier),
x AS (SELECT *, CASE WHEN o IS NULL OR w IS NULL THEN NULL WHEN o = 0 AND w = 0 THEN 0.0 WHEN o <> 0 THEN floor((w - o) / o * 1000 + 0.5) / 10 END AS delta FROM v)
SELECT field, o AS old_value, w AS new_value, delta, CASE WHEN o IS NULL OR w IS NULL THEN 'na' WHEN o = 0 AND w = 0 THEN 'green' WHEN o = 0 THEN 'red' WHEN ratio THEN CASE WHEN w < 20 THEN 'red' WHEN w < 40 THEN 'yellow' ELSE 'green' END
WHEN two THEN CASE WHEN abs(delta) >= 20 THEN 'red' WHEN abs(delta) >= 5 THEN 'yellow' ELSE 'green' END ELSE CASE WHEN delta >= 20 THEN 'red' WHEN delta >= 5 THEN 'yellow' ELSE 'green' END END AS severity FROM x""")
def baseline_diff(spark, d):
    s, key = table(spark, d, "supplier"), F.col("s_suppkey")
    old = s.select(key.alias("field"), F.when(key % 9 == 0, 0).when(key % 8 != 0, key + 10).cast("double").alias("value")).filter("value IS NOT NULL")
    new = s.select(key.alias("field"), F.when(key % 18 == 0, 0).when(key % 7 != 0, key + 10 + (key * 7) % 23 - 11).cast("double").alias("value"))
    thresholds = s.select(key.alias("field"), F.when(key % 3 == 0, 40.0).otherwise(5.0).alias("yellow"), F.lit(20.0).alias("red"), (key % 3 == 1).alias("two_sided"), (key % 3 == 0).alias("ratio"), F.lit(False).alias("exact"))
    return p.baseline_diff(old, new, thresholds)


@query("""WITH c AS (SELECT o_custkey AS file, count(*) FILTER (o_orderstatus = 'F') AS calls FROM orders GROUP BY 1) SELECT (SELECT count(*) FROM c WHERE calls > 0) AS filled, (SELECT count(*) FROM customer) AS denominator, (SELECT count(*) FROM c WHERE calls > 0) / (SELECT count(*) FROM customer) AS rate""")
def fill_rate(spark, d):
    calls = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("file")).agg(F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("calls")).withColumn("kind", F.lit("module"))
    return p.fill_rate(calls, table(spark, d, "customer").select(F.col("c_custkey").alias("file")))


@query("""WITH h AS (SELECT (value > 10)::INT AS v, ('0x' || substr(md5('7|' || event_id), 1, 16))::UBIGINT::UHUGEINT AS h FROM events WHERE value IS NOT NULL), n AS (SELECT *, 18446744073709551616::UHUGEINT AS p FROM h),
a AS (SELECT v, p, r, (h + r * 11400714819323198485::UHUGEINT) % p AS z FROM n, (SELECT unnest(range(1, 201))::UHUGEINT AS r)),
b AS (SELECT v, p, r, (xor(z, z >> 30::UHUGEINT) * 13787848793156543929::UHUGEINT) % p AS z FROM a), c AS (SELECT v, r, (xor(z, z >> 27::UHUGEINT) * 10723151780598845931::UHUGEINT) % p AS z FROM b),
u AS (SELECT v, r, (xor(z, z >> 31::UHUGEINT) >> 34::UHUGEINT)::DOUBLE / 1073741824 AS u FROM c),
w AS (SELECT v, r, len(list_filter([0.36787944117144233::DOUBLE, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563], lambda s: u >= s)) AS w FROM u),
m AS (SELECT r, sum(w * v) / sum(w) AS m FROM w GROUP BY r), l AS (SELECT list(m ORDER BY m) AS l FROM m)
SELECT l[6]::DOUBLE AS low, l[195]::DOUBLE AS high, (SELECT count(*) FROM h) AS samples FROM l""")
def proportion_ci(spark, d):
    return p.proportion_interval(table(spark, d, "events").select("event_id", (F.col("value") > 10).cast("int").alias("good")), "good", "event_id")


# --- pieces, lines and surroundings -----------------------------------------------------------------------------------


@query()
def section_chunks(spark, d):
    return h.section_chunks(table(spark, d, "documents").select(TEXT("doc_id").alias("path"), "text"))


@query(r"""WITH l AS (SELECT doc_id::VARCHAR AS path, string_split(text, chr(10)) AS l FROM documents), e AS (SELECT path, l, generate_subscripts(l, 1) AS i, unnest(l) AS t FROM l),
m AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY i) AS r, count(*) OVER (PARTITION BY path) AS total FROM e WHERE regexp_matches(t, 'th[ae]t? [a-z]+ing'))
SELECT path, i::INT AS line, t AS text, l[greatest(i - 2, 1):i - 1] AS before, l[i + 1:i + 2] AS after, total::INT AS total FROM m WHERE r <= 3""")
def pattern_context(spark, d):
    return h.find_lines(table(spark, d, "documents").select(TEXT("doc_id").alias("path"), "text"), "th[ae]t? [a-z]+ing", True, 2, 3)


FILES = "fo AS (SELECT id, kind || '/' || CAST(split_part(id, ':', 2) AS INT) % 40 AS file FROM nodes WHERE kind IN ('component', 'service', 'api-schema'))"


@query(f"""WITH RECURSIVE {NODES_SQL}, {EDGES_SQL}, {FILES}, fl AS (SELECT DISTINCT a.file AS s, b.file AS t FROM edges JOIN fo a ON a.id = source JOIN fo b ON b.id = target WHERE a.file <> b.file),
w(file, hop) AS (SELECT 'api-schema/3', 0 UNION SELECT fl.s, hop + 1 FROM w JOIN fl ON fl.t = w.file WHERE hop < 2) SELECT file, min(hop) AS hop FROM w GROUP BY file""")
def caller_files(spark, d):
    """Files of 40 for each kind of node: those that reach a file of parts within two hops."""
    owners = nodes(spark, d).filter("kind IN ('component', 'service', 'api-schema')").select("id", F.concat("kind", F.lit("/"), (F.split("id", ":")[1].cast("long") % 40).cast("string")).alias("file"))
    return h.expand_callers(edges(spark, d), owners, spark.createDataFrame([("api-schema/3",)], "file string"))


@query(f"""WITH RECURSIVE {FLOW_SQL}, f AS (SELECT DISTINCT source, target FROM flow WHERE source <> target), walk(id) AS (SELECT 'nation:7' UNION SELECT 'nation:11' UNION SELECT f.source FROM walk JOIN f ON f.target = walk.id)
SELECT f.source AS id, list(DISTINCT f.target ORDER BY f.target) AS impacted_by FROM f WHERE source IN (SELECT id FROM walk) AND target IN (SELECT id FROM walk) AND source NOT IN ('nation:7', 'nation:11') GROUP BY 1""")
def propagation(spark, d):
    return h.propagate(flow(spark, d), spark.createDataFrame([("nation:7",), ("nation:11",)], "id string"))


@query(f"""WITH {NODES_SQL}, {EDGES_SQL}, cr AS (SELECT target, source, row_number() OVER (PARTITION BY target ORDER BY score DESC, source) AS r FROM edges WHERE relation = 'calls')
SELECT n.id, label, coalesce((SELECT list(source ORDER BY source) FROM cr WHERE target = n.id AND r <= 5), []) AS callers, [] AS callees, [] AS imports, (SELECT min(source) FROM edges WHERE target = n.id AND relation = 'contains') AS container,
(SELECT count(*) FROM edges WHERE target = n.id AND relation = 'calls') AS n_callers FROM nodes n WHERE kind = 'service'""")
def service_context(spark, d):
    ids = nodes(spark, d).filter("kind = 'service'").select("id")
    return h.context(nodes(spark, d), edges(spark, d), ids, 5)
