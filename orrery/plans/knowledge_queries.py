"""Knowledge-base tools and text helpers applied to documents, benchmark, pages, conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import texts as x
from orrery.operators import knowledge as k

from .catalog import query
from .text_queries import BM25, FED, docs, hits, merged
from .views import FLOW_SQL, flow, table

RUN = r"[A-Za-z0-9._\-<>@()/]+"


def tokens_sql(rows: str) -> str:
    """Ordered tokens (id, t, o) of ``rows`` (id, text)."""
    parts = "CASE WHEN len(p) > 1 THEN list_append(p, array_to_string(p, '')) ELSE p END"
    return f"""src AS ({rows}), runs AS (SELECT id, unnest(regexp_extract_all(text, '{RUN}')) AS run, generate_subscripts(regexp_extract_all(text, '{RUN}'), 1) AS place FROM src),
parts AS (SELECT id, place, list_filter(string_split_regex(run, '[._\\-<>@()/]'), lambda p: p <> '') AS p FROM runs),
tok AS (SELECT id, unnest({parts}) AS t, place * 10000 + generate_subscripts({parts}, 1) AS o FROM parts)"""


@query(f"""WITH {tokens_sql("SELECT item_id AS id, text FROM benchmark")}, f AS (SELECT id, t, min(o) AS o FROM tok GROUP BY ALL)
SELECT src.id AS item_id, CASE WHEN count(t) = 0 THEN 'INVALID_QUERY' ELSE 'ok' END AS code, coalesce(list(t ORDER BY o) FILTER (t IS NOT NULL), []) AS tokens, string_agg('"' || t || '"', ' OR ' ORDER BY o) AS match FROM src LEFT JOIN f ON f.id = src.id GROUP BY src.id""")
def sanitised_queries(spark, d):
    return table(spark, d, "benchmark").select("item_id", k.sanitised(F.col("text")).alias("s")).select("item_id", "s.*")


@query(f"""WITH {tokens_sql("SELECT conv_id * 1000 + turn AS id, text FROM conversations")}, f AS (SELECT id, lower(t) AS t, min(o) AS o FROM tok GROUP BY ALL), e AS (SELECT src.id, coalesce(string_agg(t, ' ' ORDER BY o), '') AS e FROM src LEFT JOIN f ON f.id = src.id GROUP BY src.id),
i AS (SELECT src.id, coalesce(string_agg(t, ' ' ORDER BY o), '') AS indexed FROM src LEFT JOIN tok ON tok.id = src.id GROUP BY src.id) SELECT id, indexed, e AS equivalent, left(sha256(e), 16) AS hash FROM e JOIN i USING (id)""")
def query_hashes(spark, d):
    """Conversation turns as questions."""
    q = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    e = k.equivalence(F.col("text"))
    return q.select("id", k.index_text(F.col("text")).alias("indexed"), e.alias("equivalent"), k.short_hash(e).alias("hash"))


#: The rules in DuckDB, whose patterns know no look-behind: a leftmost run of the class begins where the run begins.
_RULES = [(t, p.replace(r"(?<![A-Za-z0-9_])", r"\b").replace(r"(?<![A-Za-z0-9+/=])", "").replace(r"(?![A-Za-z0-9+/=])", "").replace(r"(?<!\d)", "").replace(r"(?!\d)", "").replace("'", "''")) for t, p in k.REDACTIONS]
_STEPS = ", ".join(f"r{i + 1} AS (SELECT *, regexp_replace(t{i}, '{p}', '<{t}>', 'g') AS t{i + 1} FROM r{i})" for i, (t, p) in enumerate(_RULES))
_TAGS = ", ".join(f"CASE WHEN t{i} <> t{i + 1} THEN '{t}' END" for i, (t, _) in enumerate(_RULES))
#: Every text behind something to mask.
ODD = ["see https://bob:pw@host/x?a=1 ", "mail a.b@c-d.org ", "with Bearer abc.def and sk-0123456789 ", "in /home/bob/x and C:\\Users\\eve\\y ", "key Zm9vYmFyMTIzNDU2Nzg5MEFC= ", "call 0049301234567 ", ""]
_ODD = "[" + ", ".join(f"'{o}'" for o in ODD) + "]"


@query(f"WITH r0 AS (SELECT doc_id, ({_ODD})[1 + doc_id % {len(ODD)}] || text AS t0 FROM documents), {_STEPS} SELECT doc_id, md5(t{len(_RULES)}) AS hash, list_filter([{_TAGS}], lambda x: x IS NOT NULL) AS tags FROM r{len(_RULES)}")
def redacted_queries(spark, d):
    odd = F.element_at(F.array(*map(F.lit, ODD)), (F.col("doc_id") % len(ODD) + 1).cast("int"))
    out = k.redact_queries(docs(spark, d).select("doc_id", F.concat(odd, "text").alias("text")))
    return out.select("doc_id", F.md5("text").alias("hash"), "tags")


@query(f"""WITH r0 AS (SELECT conv_id, turn, text AS t0 FROM conversations WHERE role = 'user' AND text IS NOT NULL), {_STEPS}, {tokens_sql(f"SELECT conv_id * 1000 + turn AS id, t{len(_RULES)} AS text FROM r{len(_RULES)}")},
f AS (SELECT id, t, min(o) AS o FROM tok GROUP BY ALL), e AS (SELECT src.id, coalesce((SELECT string_agg(t, ' ' ORDER BY o) FROM (SELECT lower(t) AS t, min(o) AS o FROM tok WHERE tok.id = src.id GROUP BY lower(t))), '') AS e FROM src)
SELECT 1 AS schema_version, '2024010' || (1 + conv_id % 3) AS date, 'kb_search' AS tool, coalesce((SELECT list(t ORDER BY o) FROM f WHERE f.id = r.conv_id * 1000 + r.turn), []) AS terms, left(sha256(e), 16) AS query_hash,
list_filter([{_TAGS}], lambda x: x IS NOT NULL) AS tags, 0 AS result_count, left(sha256('kb' || conv_id % 3), 16) AS kb_hash FROM r{len(_RULES)} r JOIN e ON e.id = r.conv_id * 1000 + r.turn""")
def no_hit_records(spark, d):
    day = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") % 3 * 86400)
    q = table(spark, d, "conversations").filter("role = 'user'")
    return k.no_hit_records(q.select(day.alias("time"), F.lit("kb_search").alias("tool"), "text", F.concat(F.lit("kb"), (F.col("conv_id") % 3).cast("string")).alias("kb"))).drop("time")


@query(f"""WITH {BM25}, m AS (SELECT doc_id AS chunk_id, 'v' || doc_id % 3 AS sdk_version FROM documents) SELECT query_id, chunk_id, sdk_version, round(score, 6) AS score, rank FROM (
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), chunk_id)::INT AS rank FROM sc JOIN m USING (chunk_id) WHERE sdk_version = 'v1') WHERE rank <= 5""")
def kb_search_version(spark, d):
    meta = docs(spark, d).select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("v"), (F.col("doc_id") % 3).cast("string")).alias("sdk_version"))
    scored = hits(spark, d).withColumn("score", F.round("score", 9))
    return k.with_metadata(scored, meta, "v1").select("query_id", "chunk_id", "sdk_version", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {FED}, h AS (SELECT f.query_id, f.rank, left(text, 500) AS t, sum(length(left(text, 500))) OVER (PARTITION BY f.query_id ORDER BY rank) AS run FROM fed f JOIN documents ON doc_id = f.chunk_id WHERE rank <= 5)
SELECT query_id, string_agg(t, chr(10) || chr(10) ORDER BY rank) AS block, count(*) AS chunks FROM h WHERE run <= 1200 GROUP BY query_id""")
def requirement_evidence(spark, d):
    return k.requirement_evidence(merged(spark, d).select("query_id", "chunk_id", "rank"), docs(spark, d).select(F.col("doc_id").alias("chunk_id"), "text"), total=1200)


TITLES = """dn AS (SELECT 'nation:' || n_nationkey AS doc_id, n_name || ' of ' || r_name AS title, CASE WHEN n_regionkey % 2 = 0 THEN 'vendor' ELSE 'project' END AS source_kind FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def titled(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string"))
    return n.select(key.alias("doc_id"), F.concat("n_name", F.lit(" of "), "r_name").alias("title"), F.when(F.col("n_regionkey") % 2 == 0, "vendor").otherwise("project").alias("source_kind"))


def linked(spark, d):
    links = flow(spark, d).groupBy(F.col("source").alias("doc_id")).agg(F.collect_list("target").alias("links"))
    return titled(spark, d).join(links, "doc_id", "left").withColumn("links", F.concat(F.coalesce("links", F.array().cast("array<string>")), F.array(F.lit("ghost"))))


@query(f"WITH {FLOW_SQL} SELECT DISTINCT source, target, 'references' AS relation FROM flow")
def document_edges(spark, d):
    return k.document_edges(linked(spark, d))


@query(f"""WITH {FLOW_SQL}, {TITLES}, asked AS (SELECT s_suppkey AS query_id, CASE WHEN s_suppkey % 4 = 0 THEN 'nation:' || s_nationkey WHEN s_suppkey % 4 = 3 THEN '' END AS id, CASE WHEN s_suppkey % 4 < 2 THEN '_' || s_suppkey % 10 || ' OF' END AS keyword FROM supplier),
ed AS (SELECT DISTINCT f.source, f.target, a.source_kind FROM flow f JOIN dn a ON a.doc_id = f.source),
found AS (SELECT query_id, dn.* FROM asked JOIN dn ON dn.doc_id = id WHERE id <> '' UNION ALL SELECT query_id, dn.* FROM asked JOIN dn ON contains(lower(title), lower(keyword)) WHERE coalesce(id, '') = '' AND keyword <> '')
SELECT query_id, 'ok' AS code, doc_id, title, source_kind, coalesce((SELECT list(DISTINCT target ORDER BY target) FROM ed WHERE source = doc_id AND ed.source_kind = found.source_kind), []) AS refers_to,
coalesce((SELECT list(DISTINCT source ORDER BY source) FROM ed WHERE target = doc_id AND ed.source_kind = found.source_kind), []) AS referred_by FROM found
UNION ALL SELECT query_id, 'INVALID_LOOKUP_ARG', NULL, NULL, NULL, NULL, NULL FROM asked WHERE coalesce(id, '') = '' AND coalesce(keyword, '') = ''""")
def document_lookup(spark, d):
    s = F.col("s_suppkey")
    asked = table(spark, d, "supplier").select(
        s.alias("query_id"), F.when(s % 4 == 0, F.concat(F.lit("nation:"), F.col("s_nationkey").cast("string"))).when(s % 4 == 3, "").alias("id"),
        F.when(s % 4 < 2, F.concat(F.lit("_"), (s % 10).cast("string"), F.lit(" OF"))).alias("keyword"),
    )
    rows = titled(spark, d)
    refs = k.document_edges(linked(spark, d)).join(rows.select(F.col("doc_id").alias("source"), "source_kind"), "source")
    return k.lookup_documents(rows, refs, asked)


HAN = "['数据库 index', '错误码', '一个 数 据', '码 数据', ''][doc_id % 5 + 1]"
ASKED = "asked AS (SELECT * FROM (VALUES (1, '数'), (2, '数据'), (3, ' 错误 '), (4, '库 i'), (5, '据数'), (6, '数据库'), (7, 'index'), (8, '码')) t(query_id, text))"


@query(f"""WITH ch AS (SELECT doc_id AS chunk_id, coalesce(text, '') || ' ' || {HAN} AS text FROM documents), {ASKED},
hits AS (SELECT query_id, l.doc_id AS chunk_id, -1.0 - quality AS score FROM labels l JOIN asked ON query_id = 7 OR query_id = 8 AND toxic = 1),
few AS (SELECT a.query_id, trim(a.text) AS wanted FROM asked a WHERE len(regexp_extract_all(a.text, '[一-龥]')) BETWEEN 1 AND 2 AND (SELECT count(*) FROM hits h WHERE h.query_id = a.query_id) < 3),
al AS (SELECT query_id, chunk_id, score::DOUBLE AS score FROM hits UNION ALL SELECT query_id, chunk_id, 1.0 FROM few JOIN ch ON contains(ch.text, wanted) WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = few.query_id AND h.chunk_id = ch.chunk_id))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id)::INT AS rank FROM al) WHERE rank <= 5""")
def short_han_search(spark, d):
    """Questions of one or two Han characters, alone and with others, over all texts, each with a few Han words of its own."""
    words = F.get(F.array(*map(F.lit, ["数据库 index", "错误码", "一个 数 据", "码 数据", ""])), (F.col("doc_id") % 5).cast("int"))
    chunks = docs(spark, d).select(F.col("doc_id").alias("chunk_id"), F.concat(F.coalesce("text", F.lit("")), F.lit(" "), words).alias("text"))
    asked = spark.createDataFrame([(1, "数"), (2, "数据"), (3, " 错误 "), (4, "库 i"), (5, "据数"), (6, "数据库"), (7, "index"), (8, "码")], "query_id int, text string")
    labels = table(spark, d, "labels")
    some = lambda q, rows: rows.select(F.lit(q).alias("query_id"), F.col("doc_id").alias("chunk_id"), (F.lit(-1.0) - F.col("quality")).alias("score"))
    return k.han_fallback(some(7, labels).unionByName(some(8, labels.filter("toxic = 1"))), chunks, asked)


ENTITIES = """ent AS (SELECT p_partkey AS entity_id, split_part(p_name, ' ', 2) AS name, replace(p_name, ' ', '.') AS qualified, p_type AS kind, p_brand AS container, CASE WHEN p_partkey % 2 = 0 THEN 'vendor' ELSE 'project' END AS source_kind, p_partkey % 7 AS chunk_id,
CASE WHEN p_partkey % 3 = 0 THEN 'quoted ' || p_partkey END AS quote, p_partkey % 5 = 0 AS deprecated, p_name AS declared FROM part)"""


def entities(spark, d):
    key = F.col("p_partkey")
    return table(spark, d, "part").select(
        key.alias("entity_id"), F.split("p_name", " ")[1].alias("name"), F.replace("p_name", F.lit(" "), F.lit(".")).alias("qualified"), F.col("p_type").alias("kind"), F.col("p_brand").alias("container"),
        F.when(key % 2 == 0, "vendor").otherwise("project").alias("source_kind"), (key % 7).alias("chunk_id"), F.when(key % 3 == 0, F.concat(F.lit("quoted "), key.cast("string"))).alias("quote"), (key % 5 == 0).alias("deprecated"),
        F.split("p_name", " ").alias("declared"), F.array(F.lit("Size")).alias("required"),
    )


@query(f"""WITH {ENTITIES}, ask AS (SELECT n_nationkey * 5 + i AS query_id, ['Ring', 'red.widget', 'get gear now', 'nothing', 'old bo'][i + 1] AS api, CASE WHEN n_nationkey % 2 = 0 THEN 'PROMO' END AS kind, CASE WHEN n_nationkey % 3 = 0 THEN ' brand#' || n_nationkey END AS container FROM nation, range(5) t(i)),
aw AS (SELECT *, lower(trim(api)) AS q, CASE api WHEN 'red.widget' THEN ['red', 'widget', 'redwidget'] ELSE string_split(lower(api), ' ') END AS qw FROM ask),
pr AS (SELECT query_id, e.*, q, qw, list_distinct([lower(name), split_part(lower(qualified), '.', 1), split_part(lower(qualified), '.', 2), replace(lower(qualified), '.', '')]) AS ew FROM aw JOIN ent e ON (aw.kind IS NULL OR aw.kind = e.kind) AND (aw.container IS NULL OR lower(trim(aw.container)) = lower(e.container))),
ds AS (SELECT *, lower(name) = q OR lower(qualified) = q OR split_part(lower(qualified), '.', 2) = q AS ex, contains(lower(name), q) OR contains(lower(qualified), q) OR (length(name) >= 4 AND contains(q, lower(name))) AS sub, len(list_intersect(ew, qw)) AS common FROM pr),
rk AS (SELECT *, CASE WHEN ex THEN 'exact' ELSE 'fuzzy' END AS match, CASE WHEN ex THEN 0.0 WHEN sub THEN 1.0 ELSE 2.0 - common / len(qw) END::DOUBLE AS distance FROM ds WHERE ex OR sub OR common > 0),
tp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, entity_id, source_kind)::INT AS rank FROM rk)
SELECT query_id, 'entities' AS mode, entity_id, source_kind, match, distance, rank, tp.chunk_id, left(coalesce(quote, t.text, ''), 500) AS evidence, CASE WHEN deprecated THEN 'deprecated' END AS warning,
list_sort(list_filter(['red', 'colour'], lambda x: NOT list_contains(string_split(lower(declared), ' '), x))) AS unknown, ['size'] AS missing, list_sort(list_filter(['red', 'colour'], lambda x: list_contains(string_split(lower(declared), ' '), x))) AS matched
FROM tp LEFT JOIN documents t ON t.doc_id = tp.chunk_id WHERE rank <= 10 UNION ALL SELECT query_id, 'not_found', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM ask WHERE query_id NOT IN (SELECT query_id FROM tp)""")
def api_lookup(spark, d):
    """Five forms of question from every nation."""
    forms = F.array(*map(F.lit, ["Ring", "red.widget", "get gear now", "nothing", "old bo"]))
    n = F.col("n_nationkey")
    asked = table(spark, d, "nation").select("n_nationkey", F.posexplode(forms).alias("i", "api"))
    asked = asked.select((n * 5 + F.col("i")).alias("query_id"), "api", F.when(n % 2 == 0, "PROMO").alias("kind"), F.when(n % 3 == 0, F.concat(F.lit(" brand#"), n.cast("string"))).alias("container"), F.array(F.lit("Red"), F.lit("colour")).alias("given"))
    chunks = docs(spark, d).select(F.col("doc_id").alias("chunk_id"), "text")
    return k.api_lookup(asked, entities(spark, d), chunks, chunks.select(F.lit(0).alias("query_id"), "chunk_id", F.lit(1).alias("rank")))


@query("SELECT source_kind, kind, count(*) AS n FROM (SELECT 'vendor' AS source_kind, p_type AS kind FROM part WHERE p_size < 30 UNION ALL SELECT 'project', p_type FROM part WHERE p_size >= 20) WHERE source_kind = 'project' GROUP BY ALL")
def kb_sources(spark, d):
    p = table(spark, d, "part").select(F.col("p_type").alias("kind"), "p_size")
    both = k.both_sources(p.filter("p_size < 30"), p.filter("p_size >= 20"))
    return k.of_source(both, "project").groupBy("source_kind", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT doc_id, md5('[KB-EVIDENCE doc_id="' || coalesce(source, '') || '  ' || '" src="vendor" built_at="2024"]' || chr(10) || replace(replace(left('[ kb-evidence x [/KB-Evidence] ' || text, 2000), '[ kb-evidence', '[ KB-EVIDENCE'), '[/KB-Evidence]', '[ /KB-EVIDENCE ]') || chr(10) || '[/KB-EVIDENCE]') AS hash FROM documents""")
def evidence_envelopes(spark, d):
    t = F.concat(F.lit("[ kb-evidence x [/KB-Evidence] "), "text")
    return docs(spark, d).select("doc_id", F.md5(k.enveloped(t, F.concat(F.coalesce("source", F.lit("")), F.lit(']"')), F.lit("vendor"), F.lit("2024"))).alias("hash"))


CODE = r"\b(?:E\d{2,}|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*_(?:ERROR|CODE|EXCEPTION))\b"
CALL = r"([A-Za-z_$][\w$.]+)\s*\(([^)]{0,400})\)"
NOISE = ", ".join(f"'{w}'" for w in k.NOISE)


@query(rf"""WITH s AS (SELECT doc_id AS section, text || ' E10' || doc_id % 7 || ' NO_SUCH_ERROR CONST_NAME pkg.call(a, b: int, ...c = 1) if(y) pkg.call(z)' || CASE WHEN doc_id % 3 = 0 THEN ' Deprecated  since 2.' || doc_id % 4 ELSE '' END AS text FROM documents),
c AS (SELECT DISTINCT section, unnest(regexp_extract_all(text, '{CODE}')) AS name FROM s),
f AS (SELECT section, unnest(regexp_extract_all(text, '{CALL}', 1)) AS name, unnest(regexp_extract_all(text, '{CALL}', 2)) AS inside, generate_subscripts(regexp_extract_all(text, '{CALL}', 1), 1) AS o FROM s),
g AS (SELECT section, name, trim(arg_min(inside, o)) AS inside FROM f WHERE lower(string_split(name, '.')[-1]) NOT IN ({NOISE}) GROUP BY ALL),
e AS (SELECT section, name, 'error_code' AS kind, NULL AS signature, NULL AS params FROM c UNION ALL SELECT section, name, 'function', name || '(' || inside || ')',
list_filter(list_transform(string_split(inside, ','), lambda p: trim(regexp_replace(regexp_replace(trim(regexp_extract(trim(p), '^([^:=]*)', 1)), '^\.\.\.', ''), '\?$', ''))), lambda p: regexp_matches(p, '^[A-Za-z_$]')) FROM g)
SELECT e.section, name, kind, signature, params, regexp_matches(text, '(?i)@deprecated|deprecated\s+since\s+([\w.\-]+)') AS deprecated, nullif(regexp_extract(text, '(?i)deprecated\s+since\s+([\w.\-]+)', 1), '') AS since, 0.5::DOUBLE AS confidence FROM e JOIN s USING (section)""")
def heuristic_entities(spark, d):
    key = F.col("doc_id")
    more = F.concat(F.lit(" E10"), (key % 7).cast("string"), F.lit(" NO_SUCH_ERROR CONST_NAME pkg.call(a, b: int, ...c = 1) if(y) pkg.call(z)"), F.when(key % 3 == 0, F.concat(F.lit(" Deprecated  since 2."), (key % 4).cast("string"))).otherwise(""))
    return k.heuristic_entities(docs(spark, d).select(key.alias("section"), F.concat("text", more).alias("text")))


# --- text helpers -----------------------------------------------------------------------------------------------------


@query(r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') AS path FROM pages), q AS (SELECT page_id, regexp_replace('/' || array_to_string(list_filter(list_transform(['/api/', path, '{id}//', '/:user/v2/'], lambda x: trim(x, '/')), lambda x: x <> ''), '/'), '/{2,}', '/', 'g') AS path FROM p)
SELECT page_id, path, ['id', 'user'] AS params, coalesce(list_filter(string_split(path, '/'), lambda s: s <> '' AND NOT regexp_matches(s, '^[:{]') AND lower(s) <> 'api' AND NOT regexp_matches(s, '^(?i:v\d+)$'))[1], 'default') AS tag FROM q""")
def endpoint_paths(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "[?#].*$", "")
    joined = x.url_path(F.lit("/api/"), path, F.lit("{id}//"), F.lit("/:user/v2/"))
    return table(spark, d, "pages").select("page_id", joined.alias("path")).select("page_id", "path", x.path_parameters(F.col("path")).alias("params"), x.endpoint_tag(F.col("path"), F.lit("")).alias("tag"))


@query(r"""SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN text ELSE '-- ' || text END) AS body, regexp_replace(left(text, 20) || '50%_\', '([\\%_])', '\\\1', 'g') AS pattern FROM documents""")
def text_bodies(spark, d):
    front = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("---\ntitle: x\n---\n"), "text")).otherwise(F.concat(F.lit("-- "), "text"))
    return docs(spark, d).select("doc_id", F.md5(x.body(front)).alias("body"), x.like_pattern(F.concat(F.left("text", F.lit(20)), F.lit("50%_\\"))).alias("pattern"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents), t AS (SELECT doc_id, unnest(regexp_extract_all(l, '[^ \t\n\x0B\f\r]+')) AS token FROM l)
SELECT doc_id, token, count(*) AS n FROM t GROUP BY ALL HAVING count(*) > 3""")
def diff_tokens(spark, d):
    """Each text as a diff that adds its lines: the bag of tokens of what it adds."""
    diff = F.concat(F.lit("--- a\n+++ b\n@@ -1 +1 @@\n same\n+"), F.replace("text", F.lit("\n"), F.lit("\n+")))
    lines = docs(spark, d).select("doc_id", F.explode(x.semantic_lines(diff)).alias("l"))
    tokens = lines.select("doc_id", F.explode(F.split("l", r"\s+")).alias("token")).filter("token <> ''")
    return tokens.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n")).filter("n > 3")


@query(r"""WITH p AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS place, CASE doc_id % 3 WHEN 0 THEN '[a link](http://example.com/a/long/path) ' WHEN 1 THEN '# ' ELSE '' END || unnest(string_split(text, chr(10))) AS t FROM documents),
q AS (SELECT *, trim(t) AS s, list_sum(list_transform(regexp_extract_all(trim(t), '\[[^\]]*\]\([^)]+\)'), lambda x: length(x))) AS links FROM p), r AS (SELECT *, length(s) > 0 AND coalesce(links, 0) > length(s) * 0.5 AS heavy FROM q)
SELECT doc_id, place - 1 AS line, heavy, length(s) >= 20 AND NOT regexp_matches(s, '^(#|<|!\[|\|)') AND NOT heavy AS descriptive, 0.0::DOUBLE AS han FROM r""")
def paragraph_kinds(spark, d):
    front = F.when(F.col("doc_id") % 3 == 0, "[a link](http://example.com/a/long/path) ").when(F.col("doc_id") % 3 == 1, "# ").otherwise("")
    p = docs(spark, d).select("doc_id", front.alias("f"), F.posexplode(F.split("text", "\n")).alias("at", "t")).withColumn("t", F.concat("f", "t"))
    return p.select("doc_id", F.col("at").cast("long").alias("line"), x.link_heavy(F.col("t")).alias("heavy"), x.descriptive(F.col("t")).alias("descriptive"), x.han_share(F.col("t")).alias("han"))


@query("""SELECT date, count(*) AS n, strftime(max(t), '%Y-%m-%d %H:%M:%S') AS last FROM (SELECT CASE WHEN event_id % 5 <> 0 THEN strftime(ts, '%Y-%m-%d') END AS date, greatest(ts, CASE WHEN event_id % 2 = 0 THEN TIMESTAMP '2024-01-15' END) AS t FROM events) GROUP BY date""")
def event_days(spark, d):
    text = F.when(F.col("event_id") % 5 == 0, "2024-13-45T00:00:00Z").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    late = x.latest(F.col("ts").cast("timestamp_ntz"), F.when(F.col("event_id") % 2 == 0, F.lit("2024-01-15").cast("timestamp_ntz")))
    days = table(spark, d, "events").select(x.date_bucket(text).alias("date"), late.alias("t")).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("t"))
    return days.select("date", "n", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("last"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '(?i)<br\s*/?>|</(p|div|li|tr|h[1-6])>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM a)
SELECT page_id, md5(trim(regexp_replace(regexp_replace(t, '[ \t\r\x0b\f]+', ' ', 'g'), ' ?\n[\n ]*', chr(10), 'g'))) AS hash FROM b""")
def clean_pages(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(x.clean_html(F.col("html"))).alias("hash"))
