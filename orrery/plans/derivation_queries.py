"""Derivation, audit and selection operators applied to the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import derivation as v
from orrery.operators.graph import degree_total
from orrery.sources.sinks import drawing, mermaid

from .catalog import query
from .views import EDGES_SQL, FLOW_SQL, NODES_SQL, edges, flow, nodes, table

GRAPH = f"WITH {NODES_SQL}, {EDGES_SQL}"
FLOW = f"WITH {FLOW_SQL}"


def skeletons(spark, d):
    """A file for each customer nation's segment, its customers as exports, a supplier nation's file as import."""
    c = table(spark, d, "customer")
    member = F.array(F.concat(F.lit("m"), (F.col("c_custkey") % 3).cast("string")), F.lit("size"))
    e = F.struct(F.col("c_name").alias("name"), F.lit("class").alias("kind"), (F.col("c_custkey") % 5 == 0).alias("reexport"), member.alias("members"))
    file = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("/"), "c_mktsegment")
    imports = F.array(F.struct(F.concat(F.lit("n"), (F.col("c_nationkey") % 7).cast("string"), F.lit("/"), "c_mktsegment").alias("resolved"), F.lit("static").alias("type")))
    return c.groupBy(file.alias("file")).agg(F.array_sort(F.collect_list(e)).alias("exports"), F.first(imports).alias("imports"))


CUST = "cu AS (SELECT 'n' || c_nationkey || '/' || c_mktsegment AS file, c_name AS name, c_custkey AS k, c_nationkey AS nk, c_mktsegment AS seg FROM customer)"
DERIVED = f"""{CUST}, dn AS (SELECT DISTINCT file AS id, 'module' AS kind, split_part(file, '/', 2) AS label, file FROM cu UNION ALL SELECT file || '::' || name, 'class', name, file FROM cu WHERE k % 5 <> 0
UNION ALL SELECT file || '::' || name || '.m' || k % 3, 'member', 'm' || k % 3, file FROM cu WHERE k % 5 <> 0 UNION ALL SELECT file || '::' || name || '.size', 'member', 'size', file FROM cu WHERE k % 5 <> 0)"""


@query(f"WITH {DERIVED} SELECT * FROM dn")
def derived_nodes(spark, d):
    return v.derive_nodes(skeletons(spark, d))


@query(f"WITH {CUST} SELECT DISTINCT file AS source, 'n' || nk % 7 || '/' || seg AS target, 'depends-on' AS relation, 'static' AS import_type FROM cu WHERE nk <> nk % 7")
def import_edges(spark, d):
    return v.import_edges(skeletons(spark, d))


@query(f"""WITH {CUST} SELECT file AS source, file || '::' || name AS target FROM cu WHERE k % 5 <> 0 UNION ALL SELECT file || '::' || name, file || '::' || name || '.m' || k % 3 FROM cu WHERE k % 5 <> 0
UNION ALL SELECT file || '::' || name, file || '::' || name || '.size' FROM cu WHERE k % 5 <> 0""")
def contains_edges(spark, d):
    return v.contains_edges(v.derive_nodes(skeletons(spark, d)))


@query("""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', '/'), '[?#].*$', '') AS path FROM pages) SELECT page_id, CASE WHEN path LIKE '/m.%' THEN path ELSE path[2:] END AS id, path LIKE '/m.%' AS external FROM p""")
def relative_ids(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", "/"), "[?#].*$", "")
    inside = F.when(path.startswith("/m."), path).otherwise(F.replace(F.concat(F.lit("/root"), path), F.lit("/"), F.when(F.col("page_id") % 2 == 0, "/").otherwise("\\")))
    key, external = v.relative_id(F.when(path.startswith("/m."), inside).otherwise(F.regexp_replace(inside, r"^\\root", "/root")), "/root")
    return table(spark, d, "pages").select("page_id", key.alias("id"), external.alias("external"))


@query("""WITH f AS (SELECT 'nation:' || n_nationkey AS file, n_regionkey % 3 AS language FROM nation), """ + FLOW_SQL + """
SELECT DISTINCT a.language, target FROM flow JOIN f a ON a.file = source JOIN f b ON b.file = target WHERE a.language <> b.language""")
def cross_language(spark, d):
    files = table(spark, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("file"), (F.col("n_regionkey") % 3).alias("language"))
    return v.cross_language(flow(spark, d), files)


@query(f"""{FLOW}, m AS (SELECT 'nation:' || n_nationkey AS id, n_regionkey AS grp FROM nation), p AS (SELECT x.grp AS a, y.grp AS b, count(*) AS n FROM flow JOIN m x ON x.id = source JOIN m y ON y.id = target WHERE x.grp <> y.grp GROUP BY ALL)
SELECT grp, counterpart, sum(o)::BIGINT AS outgoing, sum(i)::BIGINT AS incoming, CASE WHEN sum(i) = 0 THEN 'out' WHEN sum(o) = 0 THEN 'in' ELSE 'both' END AS direction
FROM (SELECT a AS grp, b AS counterpart, n AS o, 0 AS i FROM p UNION ALL SELECT b, a, 0, n FROM p) GROUP BY grp, counterpart""")
def cross_references(spark, d):
    groups = table(spark, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_regionkey").alias("grp"))
    return v.cross_references(flow(spark, d), groups)


PATHS = "CASE WHEN c_custkey % 9 = 0 THEN 'tools/' ELSE 'src/' END || 'n' || c_nationkey || '/' || c_mktsegment || '/' || c_custkey || '.py'"


@query(f"""SELECT path, CASE WHEN path LIKE 'src/%' THEN split_part(path, '/', 2) ELSE 'tools' END AS grp FROM (SELECT {PATHS} AS path FROM customer)""")
def module_groups(spark, d):
    return v.module_groups(paths(spark, d))


def paths(spark, d):
    top = F.when(F.col("c_custkey") % 9 == 0, "tools").otherwise("src")
    return table(spark, d, "customer").select(F.concat(F.concat_ws("/", top, F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), "c_mktsegment", F.col("c_custkey").cast("string")), F.lit(".py")).alias("path"))


@query("""SELECT source AS grp, CASE WHEN count(*) = 1 THEN max(md5(text)) ELSE sha256(string_agg(md5(text), '' ORDER BY doc_id)) END AS hash FROM documents GROUP BY source""")
def combined_hashes(spark, d):
    return v.combined_hash(table(spark, d, "documents").select(F.col("source").alias("grp"), F.col("doc_id").alias("path"), F.md5("text").alias("hash")))


@query("""WITH ex AS (SELECT doc_id, doc_id AS chunk_id, text FROM documents WHERE doc_id % 3 <> 0), inc AS (SELECT doc_id, doc_id + 1000000 AS chunk_id, text FROM documents WHERE doc_id % 2 = 0),
kept AS (SELECT * FROM ex WHERE doc_id NOT IN (SELECT doc_id FROM inc)), f AS (SELECT arg_min(doc_id, chunk_id) AS doc_id, min(chunk_id) AS chunk_id, text FROM inc WHERE length(text) >= 20 GROUP BY text)
SELECT doc_id, chunk_id, md5(text) AS hash FROM kept UNION ALL SELECT doc_id, chunk_id, md5(text) FROM f WHERE text NOT IN (SELECT text FROM kept)""")
def ingest_plan(spark, d):
    docs = table(spark, d, "documents")
    existing = docs.filter("doc_id % 3 <> 0").select("doc_id", F.col("doc_id").alias("chunk_id"), "text")
    incoming = docs.filter("doc_id % 2 = 0").select("doc_id", (F.col("doc_id") + 1000000).alias("chunk_id"), "text")
    return v.ingest(existing, incoming).select("doc_id", "chunk_id", F.md5("text").alias("hash"))


AUDIT = """au AS (SELECT unit, level, list_sort(list_filter([CASE WHEN specs = 0 THEN 'missing-doc' END, CASE WHEN specs > 0 AND links = 0 THEN 'missing-links' END, CASE WHEN specs > 0 AND confidence < 0.5 THEN 'low-confidence' END], lambda x: x IS NOT NULL)) AS issues FROM (
SELECT n_nationkey AS unit, n_regionkey AS level, count(DISTINCT s_suppkey) AS specs, max(s_suppkey % 2) AS links, max(s_acctbal / 10000) AS confidence FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL)),
st AS (SELECT *, CASE WHEN list_contains(issues, 'missing-doc') THEN 'missing-doc' WHEN len(issues) > 0 THEN 'attention' ELSE 'documented' END AS status FROM au)"""


def audit(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    units = n.select(F.col("n_nationkey").alias("unit"), F.array("n_nationkey").alias("files"))
    specs = s.select(F.col("s_suppkey").alias("spec"), F.array("s_nationkey").alias("files"), (F.col("s_suppkey") % 2).alias("links"), (F.col("s_acctbal") / 10000).alias("confidence"))
    return v.coverage_audit(units, specs)


@query(f"WITH {AUDIT} SELECT unit, issues, status FROM st")
def coverage_audit(spark, d):
    return audit(spark, d)


@query(f"""WITH {AUDIT} SELECT level, count(*) AS total, count(CASE WHEN status = 'documented' THEN 1 END) AS documented, count(CASE WHEN status = 'missing-doc' THEN 1 END) AS missing,
count(CASE WHEN status = 'attention' THEN 1 END) AS attention, round(count(CASE WHEN status = 'documented' THEN 1 END) * 100 / count(*), 1) AS percent FROM st GROUP BY level""")
def level_coverage(spark, d):
    return v.level_coverage(audit(spark, d).join(table(spark, d, "nation").select(F.col("n_nationkey").alias("unit"), F.col("n_regionkey").alias("level")), "unit"))


@query(f"""{FLOW}, k AS (SELECT 'nation:' || n_nationkey AS doc_id FROM nation), e AS (SELECT DISTINCT source, target FROM flow)
SELECT doc_id, coalesce((SELECT list(target ORDER BY target) FROM e WHERE source = doc_id), []) AS refers_to, coalesce((SELECT list(source ORDER BY source) FROM e WHERE target = doc_id), []) AS referred_by FROM k""")
def document_references(spark, d):
    """Nations as documents; every one also has a link to what isn't a document."""
    docs = table(spark, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("doc_id"))
    ghosts = docs.select(F.col("doc_id").alias("source"), F.lit("ghost").alias("target"))
    return v.references(flow(spark, d).select("source", "target").unionByName(ghosts), docs)


@query("""SELECT doc_id AS id, 0 AS line, 'TODO' AS tag, 'ann' AS owner, 'medium' AS severity, 'a' AS note FROM documents UNION ALL
SELECT doc_id, 2 + length(text) - length(replace(text, chr(10), '')), 'FIXME', NULL, 'high', 'b' FROM documents""")
def debt_comments(spark, d):
    """Every text between two comments; no text has one of its own."""
    text = F.concat(F.lit("# TODO(ann): a\n"), "text", F.lit("\n// FIXME b"))
    return v.debt_comments(table(spark, d, "documents").select("doc_id", text.alias("text")), "doc_id", "text")


@query(r"""WITH t AS (SELECT doc_id, text || CASE WHEN doc_id % 4 = 0 THEN ' open question.' WHEN doc_id % 3 = 0 THEN ' why? ' ELSE ' so.' END AS text FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\b(tbd|open question|to be decided|unresolved|trade-?off)\b') THEN 'confirmed' ELSE 'candidate' END AS verdict, left(text, 400) AS snippet FROM t WHERE regexp_matches(text, '(?i)\b(tbd|open question|to be decided|unresolved|trade-?off)\b') OR ends_with(rtrim(text), '?')""")
def open_questions(spark, d):
    text = F.concat("text", F.when(F.col("doc_id") % 4 == 0, " open question.").when(F.col("doc_id") % 3 == 0, " why? ").otherwise(" so."))
    return v.open_questions(table(spark, d, "documents").select("doc_id", text.alias("text"))).select("doc_id", "verdict", "snippet")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS o, length(text) - length(replace(text, chr(10), '')) AS n FROM documents)
SELECT doc_id AS id, o AS line, ['A'] AS path, t AS text FROM l WHERE trim(t) <> '' UNION ALL SELECT DISTINCT doc_id, n + 6, ['A', 'B'], 'two' FROM l UNION ALL SELECT doc_id, n + 7 + o, ['C'], t FROM l WHERE trim(t) <> ''""")
def section_path(spark, d):
    """Every text as two sections, with a fenced heading between them; no text has headings or fences of its own."""
    text = F.concat(F.lit("# A\n"), "text", F.lit("\n## B\n```\n# code\n```\ntwo\n# C\n"), "text")
    return v.sections(table(spark, d, "documents").select("doc_id", text.alias("text")), "doc_id", "text").select("id", F.col("line").cast("long").alias("line"), "path", "text")


@query("""WITH c AS (SELECT l_suppkey AS project, CASE WHEN l_suppkey % 5 = 0 AND l_linenumber = 1 THEN 'explicit' WHEN l_linenumber <= l_suppkey % 3 THEN 'lockfile' ELSE 'range' END AS origin, 'v' || CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE l_linenumber END AS version FROM lineitem)
SELECT project, CASE WHEN max(CASE WHEN origin = 'explicit' THEN version END) IS NOT NULL THEN max(CASE WHEN origin = 'explicit' THEN version END) WHEN count(DISTINCT CASE WHEN origin = 'lockfile' THEN version END) = 1 THEN max(CASE WHEN origin = 'lockfile' THEN version END) END AS version,
CASE WHEN max(CASE WHEN origin = 'explicit' THEN version END) IS NOT NULL THEN 'explicit' WHEN count(DISTINCT CASE WHEN origin = 'lockfile' THEN version END) > 1 THEN 'ambiguous' WHEN count(DISTINCT CASE WHEN origin = 'lockfile' THEN version END) = 1 THEN 'lockfile'
WHEN count(CASE WHEN origin = 'range' THEN 1 END) > 0 THEN 'range-only' ELSE 'none' END AS verdict FROM c GROUP BY project""")
def resolve_version(spark, d):
    k, n = F.col("l_suppkey"), F.col("l_linenumber")
    origin = F.when((k % 5 == 0) & (n == 1), "explicit").when(n <= k % 3, "lockfile").otherwise("range")
    version = F.concat(F.lit("v"), F.when(k % 2 == 0, 1).otherwise(n).cast("string"))
    return v.resolve_version(table(spark, d, "lineitem").select(k.alias("project"), origin.alias("origin"), version.alias("version")))


@query(f"""{GRAPH} SELECT id, sum(CASE WHEN contains(lower(label), term) THEN 1.0 ELSE 0 END + CASE WHEN contains(lower(id), term) THEN 0.5 ELSE 0 END)::DOUBLE AS weight
FROM nodes, (SELECT unnest(['ring', 'supplier', 'nation']) AS term) WHERE contains(lower(label), term) OR contains(lower(id), term) GROUP BY id""")
def question_seeds(spark, d):
    return v.seeds(nodes(spark, d), spark.createDataFrame([("ring",), ("Supplier",), ("nation",)], "term string"))


@query("""WITH s AS (SELECT p_brand AS subject, p_type AS pattern, sum(CASE WHEN p_size > 25 THEN p_size ELSE 0 END)::DOUBLE / sum(p_size) AS score FROM part GROUP BY ALL)
SELECT subject, pattern, round(score, 6) AS score, row_number() OVER w ::INT AS rank, round(score - lead(score) OVER w, 6) AS gap FROM s WHERE score >= 0.3 WINDOW w AS (PARTITION BY subject ORDER BY score DESC, pattern)""")
def pattern_hints(spark, d):
    signals = table(spark, d, "part").select(F.col("p_brand").alias("subject"), F.col("p_type").alias("pattern"), F.col("p_size").cast("double").alias("weight"), (F.col("p_size") > 25).alias("matched"), F.lit(0.0).alias("penalty"))
    return v.pattern_hints(signals).select("subject", "pattern", F.round("score", 6).alias("score"), "rank", F.round("gap", 6).alias("gap"))


@query("""SELECT p_brand || '/' || split_part(p_name, ' ', 1) AS directory, CASE WHEN max(p_size / 50.0) < 0.6 THEN 'source' ELSE max_by(p_type, (p_size, p_type)) END AS class FROM part GROUP BY 1""")
def directory_class(spark, d):
    signals = table(spark, d, "part").select(F.concat("p_brand", F.lit("/"), F.split("p_name", " ")[0]).alias("directory"), (F.col("p_size") / 50.0).alias("weight"), F.col("p_type").alias("category"))
    return v.directory_class(signals)


@query("""SELECT grp, priority, id, cost, spent FROM (SELECT source AS grp, doc_id % 3 AS priority, doc_id AS id, n_chars AS cost, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id % 3, doc_id)::BIGINT AS spent FROM documents) WHERE spent <= 20000""")
def within_budget(spark, d):
    items = table(spark, d, "documents").select(F.col("source").alias("grp"), (F.col("doc_id") % 3).alias("priority"), F.col("doc_id").alias("id"), F.col("n_chars").alias("cost"))
    return v.within_budget(items, 20000)


@query("""WITH st AS (SELECT p_partkey AS path, CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS hash, CASE p_partkey % 5 WHEN 0 THEN 'draft' WHEN 1 THEN NULL WHEN 2 THEN 'Canonical' ELSE 'canonical' END AS kind FROM part),
cu AS (SELECT p_partkey AS path, p_type AS hash, 'canonical' AS kind FROM part WHERE p_partkey % 6 = 0) SELECT * FROM cu UNION ALL SELECT path, hash, 'canonical' FROM st WHERE hash IS NOT NULL AND coalesce(kind, '') <> 'draft' AND path NOT IN (SELECT path FROM cu)""")
def merge_known(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    kind = F.when(k % 5 == 0, "draft").when(k % 5 == 1, None).when(k % 5 == 2, "Canonical").otherwise("canonical")
    stored = p.select(k.alias("path"), F.when(k % 4 != 0, F.col("p_name")).alias("hash"), kind.alias("kind"))
    return v.merge_known(stored, p.filter("p_partkey % 6 = 0").select(k.alias("path"), F.col("p_type").alias("hash"), F.lit("canonical").alias("kind")))


@query(f"""{FLOW} SELECT '  ' || regexp_replace(source, '[^A-Za-z0-9_]', '_', 'g') || ' -->|' || relation || '| ' || regexp_replace(target, '[^A-Za-z0-9_]', '_', 'g') AS line FROM flow""")
def mermaid_lines(spark, d):
    return mermaid(flow(spark, d))


@query(f"""{GRAPH} SELECT id, (round(n_regionkey / 5 * 360)::INT % 360) AS hue, round(4 + 16 * ln(1 + degree) / ln(1001)) AS radius FROM (
SELECT n.id, count(e.id) AS degree FROM nodes n LEFT JOIN (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) e ON n.id = e.id WHERE kind = 'module' GROUP BY n.id) JOIN nation ON 'nation:' || n_nationkey = id""")
def drawing_attributes(spark, d):
    n = nodes(spark, d).filter("kind = 'module'")
    region = table(spark, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_regionkey").alias("community"))
    return drawing(degree_total(n, edges(spark, d)).join(region, "id"), 5).select("id", "hue", "radius")
