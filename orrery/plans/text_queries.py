"""Retrieval and vector operators applied to documents, benchmark, pages and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions.durable import stored
from orrery.functions.expressions import estimated_tokens
from orrery.operators import retrieval as r

from .catalog import query
from .views import table

SOURCE = "CASE WHEN doc_id % 2 = 0 THEN 'vendor' ELSE 'project' END"
#: The tokenizer in DuckDB (no Han characters in the tables).
TOKENS = """runs AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '[A-Za-z0-9._\\-<>@()/]+')) AS run, generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9._\\-<>@()/]+'), 1) AS place FROM documents),
parts AS (SELECT doc_id, place, list_filter(string_split_regex(run, '[._\\-<>@()/]'), lambda p: p <> '') AS p FROM runs),
tokens AS (SELECT doc_id, unnest(CASE WHEN len(p) > 1 THEN list_append(p, array_to_string(p, '')) ELSE p END) AS token FROM parts)"""
POSTINGS = f"""{TOKENS}, dls AS (SELECT doc_id, count(*) AS dl FROM tokens GROUP BY 1),
post AS (SELECT lower(token) AS term, t.doc_id AS chunk_id, count(*) AS tf, any_value(dl)::INT AS dl FROM tokens t JOIN dls USING (doc_id) GROUP BY ALL)"""
QUERY_TERMS = """qt AS (SELECT item_id AS query_id, lower(term) AS term, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS term FROM benchmark) GROUP BY ALL)"""
BM25 = f"""{POSTINGS}, {QUERY_TERMS}, st AS (SELECT count(*) AS n, avg(coalesce(dl, 0)) AS avgdl FROM documents LEFT JOIN dls USING (doc_id)),
w AS (SELECT term, avgdl, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM (SELECT term, count(*) AS df FROM post GROUP BY 1), st),
sc AS (SELECT query_id, chunk_id, -sum(q * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN w USING (term) JOIN post USING (term) GROUP BY ALL)"""


def docs(spark, d):
    return table(spark, d, "documents")


def index(spark, d):
    """The folder of the documents' stored index."""
    return stored(spark, "index", [f"{d}/documents.parquet"], lambda at: r.store_index(docs(spark, d), at, "doc_id", "text"))


def asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))).alias("term"))


def hits(spark, d, top=None):
    return r.search(spark, index(spark, d), asked(spark, d), top)


@query(f"WITH {TOKENS} SELECT doc_id, count(*) AS n, count(DISTINCT token) AS distinct_n FROM tokens GROUP BY 1")
def kb_tokens(spark, d):
    return docs(spark, d).select("doc_id", F.explode(r.token_bag(F.col("text"))).alias("t")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("t").alias("distinct_n"))


@query(f"WITH {POSTINGS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM post GROUP BY term")
def kb_postings(spark, d):
    return r.read_index(spark, index(spark, d)).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


@query(f"""WITH {BM25} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), chunk_id)::INT AS rank FROM sc) WHERE rank <= 5""")
def kb_search_bm25(spark, d):
    return hits(spark, d, 5).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


FED = f"""{BM25}, src AS (SELECT query_id, chunk_id, round(score, 9) AS score, CASE WHEN chunk_id % 2 = 0 THEN 'vendor' ELSE 'project' END AS source FROM sc),
t10 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score, chunk_id) AS r FROM src) WHERE r <= 10),
nm AS (SELECT *, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-9 THEN 1.0 ELSE round((max(score) OVER w - score) / (max(score) OVER w - min(score) OVER w + 1e-9), 9) END AS norm FROM t10 WINDOW w AS (PARTITION BY query_id, source)),
rs AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY norm DESC, chunk_id) = 1 AS reserved FROM nm),
fed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY reserved DESC, norm DESC, source, chunk_id)::INT AS rank FROM rs)"""


def merged(spark, d, top=5):
    sourced = hits(spark, d).withColumn("score", F.round("score", 9)).withColumn("source", F.when(F.col("chunk_id") % 2 == 0, "vendor").otherwise("project"))
    from pyspark.sql import Window

    best = Window.partitionBy("query_id", "source").orderBy("score", "chunk_id")
    ten = sourced.withColumn("r", F.row_number().over(best)).filter("r <= 10").drop("r")
    return r.federated(ten, top)


@query(f"WITH {FED} SELECT query_id, chunk_id, source, round(norm, 5) AS norm, rank FROM fed WHERE rank <= 5")
def kb_search_federated(spark, d):
    return merged(spark, d).select("query_id", "chunk_id", "source", F.round("norm", 5).alias("norm"), "rank")


@query(f"""WITH {FED}, x AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS category, doc_id FROM benchmark b JOIN documents t ON contains(t.text, b.text))
SELECT category, count(*) AS queries, sum(hit)::BIGINT AS hits, avg(hit) AS recall FROM (
SELECT x.query_id, category, max(CASE WHEN f.chunk_id IS NULL THEN 0 ELSE 1 END) AS hit FROM x LEFT JOIN (SELECT * FROM fed WHERE rank <= 5) f ON f.query_id = x.query_id AND f.chunk_id = x.doc_id GROUP BY ALL) GROUP BY category""")
def recall_at_k(spark, d):
    """Items that documents quote: does retrieval find one of those documents?"""
    found = merged(spark, d).select("query_id", F.col("chunk_id").alias("doc_id"), "rank")
    items = table(spark, d, "benchmark")
    quoted = r.quoting(docs(spark, d), items.select(F.col("item_id").alias("query_id"), "text"))
    quoted = quoted.withColumn("category", F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd"))
    return r.recall_at_k(found, quoted)


@query(f"""WITH k AS (SELECT doc_id // 3 AS doc_id, {SOURCE} AS source, n_chars AS time FROM documents)
SELECT doc_id, source, time, CASE WHEN (SELECT count(DISTINCT source) FROM k x WHERE x.doc_id = k.doc_id) >= 2 THEN time = max(time) OVER (PARTITION BY doc_id) END AS newest FROM k""")
def kb_freshness(spark, d):
    k = docs(spark, d).select(F.expr("doc_id div 3").alias("doc_id"), F.when(F.col("doc_id") % 2 == 0, "vendor").otherwise("project").alias("source"), F.col("n_chars").alias("time"))
    return r.freshness_flags(k)


STOPS = ", ".join(f"'{w}'" for w in r.STOP)


@query(f"""WITH {TOKENS} SELECT id, term, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, term)::INT AS rank FROM (
SELECT id, term, n * CASE WHEN length(term) = 1 THEN 3 ELSE 10 END / 10 AS weight FROM (SELECT doc_id AS id, lower(token) AS term, count(*) AS n FROM tokens WHERE lower(token) NOT IN ({STOPS}) GROUP BY ALL))) WHERE rank <= 8""")
def keywords_topn(spark, d):
    return r.keywords(docs(spark, d), "doc_id", "text")


@query("""WITH q AS (SELECT DISTINCT p_name AS query FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part), e AS (SELECT p_partkey AS entity_id, lower(p_name) AS name FROM part),
x AS (SELECT query, entity_id, CASE WHEN query = name THEN 0.0 WHEN contains(name, query) THEN 1.0
 ELSE 2.0 - len(list_intersect(list_distinct(string_split(query, ' ')), list_distinct(string_split(name, ' ')))) / len(list_distinct(string_split(query, ' '))) END AS distance
 FROM q, e WHERE list_has_any(string_split(query, ' '), string_split(name, ' ')))
SELECT query, entity_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, entity_id)::INT AS rank FROM x) WHERE rank <= 10""")
def entity_match(spark, d):
    """Every name and every last word of one as a question."""
    p = table(spark, d, "part")
    q = p.select(F.explode(F.array(F.col("p_name"), F.split("p_name", " ")[1])).alias("query")).distinct()
    return r.match_entities(q, p.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name")))


@query("""WITH c AS (SELECT p_name AS entity_id, p_partkey AS candidate, p_type AS signature, p_size / 50.0::DOUBLE AS version, CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice / 2000 END AS recency, (p_partkey % 7) / 7.0::DOUBLE AS confidence FROM part),
s AS (SELECT *, (coalesce(version, 0) * 0.4::DOUBLE + coalesce(recency, 0) * 0.2::DOUBLE + coalesce(confidence, 0) * 0.4::DOUBLE) / (0.4::DOUBLE + CASE WHEN recency IS NULL THEN 0 ELSE 0.2::DOUBLE END + 0.4::DOUBLE) AS score,
 max(version) OVER w AS mv, max(confidence) OVER w AS mc FROM c WINDOW w AS (PARTITION BY entity_id)),
k AS (SELECT * FROM c SEMI JOIN (SELECT entity_id FROM c GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT signature) > 1) USING (entity_id))
SELECT entity_id, candidate, round(score, 6) AS score, rank, coalesce(rank = 1 AND (version = mv OR confidence = mc) AND score - nx >= 0.05, false) AS recommended FROM (
SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, candidate)::INT AS rank, lead(score) OVER (PARTITION BY entity_id ORDER BY score DESC, candidate) AS nx FROM s WHERE entity_id IN (SELECT entity_id FROM k))""")
def entity_arbitration(spark, d):
    p = table(spark, d, "part")
    c = p.select(
        F.col("p_name").alias("entity_id"), F.col("p_partkey").alias("candidate"), F.col("p_type").alias("signature"), (F.col("p_size") / F.lit(50.0)).alias("version"),
        F.when(F.col("p_partkey") % 4 != 0, F.col("p_retailprice") / 2000).alias("recency"), ((F.col("p_partkey") % 7) / F.lit(7.0)).alias("confidence"),
    )
    return r.arbitrate(c).select("entity_id", "candidate", F.round("score", 6).alias("score"), "rank", "recommended")


@query("""SELECT p_partkey, list_sort(list_filter(g, lambda x: NOT list_contains(['red', 'widget', 'small'], x))) AS unknown, list_sort(list_filter(['red'], lambda x: NOT list_contains(g, x))) AS missing,
list_sort(list_filter(g, lambda x: list_contains(['red', 'widget', 'small'], x))) AS matched FROM (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS g FROM part)""")
def param_check(spark, d):
    c = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("given"), F.array(F.lit("Red"), F.lit("widget"), F.lit("SMALL")).alias("declared"), F.array(F.lit("red")).alias("required"))
    return r.check_parameters(c).select("p_partkey", "unknown", "missing", "matched")


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query(f"SELECT doc_id, regexp_replace(text, '{EMAIL}', '<email>', 'g') AS text, len(regexp_extract_all(text, '{EMAIL}'))::INT AS n FROM documents")
def redact_email(spark, d):
    return docs(spark, d).select("doc_id", F.regexp_replace("text", EMAIL, "<email>").alias("text"), F.regexp_count("text", F.lit(EMAIL)).alias("n"))


@query()
def redact_queries(spark, d):
    text, tags = r.redact(F.col("text"))
    return docs(spark, d).select("doc_id", text.alias("text"), tags.alias("tags")).filter("size(tags) > 0")


@query("SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS quarter, ceil(length(text) / 3.5)::BIGINT AS prose, ceil(length(text) / 3.8)::BIGINT AS code FROM documents")
def token_estimates(spark, d):
    return docs(spark, d).select("doc_id", *[estimated_tokens(F.col("text"), x).cast("long").alias(n) for n, x in (("quarter", 4.0), ("prose", 3.5), ("code", 3.8))])


@query("SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages")
def html_titles(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))


@query()
def chunks(spark, d):
    return r.chunk(docs(spark, d))


@query("""SELECT doc_id, place - 1 AS line, l AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents) WHERE place BETWEEN 2 AND 4""")
def line_slice(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).filter("line BETWEEN 1 AND 3").withColumn("line", F.col("line").cast("long"))


@query("""SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE contains(l, 'token') GROUP BY doc_id""")
def pattern_search(spark, d):
    return docs(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("l")).filter(F.col("l").contains("token")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


# --- vectors ------------------------------------------------------------------------------------------------------

COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({COS}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {COS} >= 0.3")
def cosine_pairs(spark, d):
    v = vectors(spark, d)
    return r.similar_pairs(v, v, 0.3).filter("a < b").select("a", "b", F.round("score", 6).alias("score"))


@query(f"""SELECT a, b, round(score, 6) AS score, rank FROM (SELECT a.vec_id AS a, b.vec_id AS b, {COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COS}, 9) DESC, b.vec_id)::INT AS rank
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 10""")
def similar_topk(spark, d):
    from pyspark.sql import Window

    v = vectors(spark, d)
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc(F.round("score", 9)), "b"))
    return r.similar_pairs(v, v, -1.0, top=10).withColumn("rank", rank).select("a", "b", F.round("score", 6).alias("score"), "rank")


@query(rf"""WITH c AS (SELECT doc_id AS chunk, text || ' ' || ['ring', 'bolt', 'gear', 'widget'][1 + doc_id % 4] AS text, embedding FROM documents JOIN embeddings ON vec_id = doc_id), n AS (SELECT p_partkey AS node, split_part(p_name, ' ', 2) AS name, embedding FROM part JOIN embeddings ON vec_id = p_partkey),
x AS (SELECT chunk, node, text, name, {COS} AS score FROM c a JOIN n b ON chunk <> node WHERE {COS} >= 0.25)
SELECT chunk, node, CASE WHEN regexp_matches(lower(text), '(^|[^\pL\pN_])' || name || '($|[^\pL\pN_])') THEN 'references' ELSE 'conceptually_related_to' END AS relation, round(score, 4) AS score FROM x""")
def semantic_edges(spark, d):
    """Documents and parts with the vector of their number: pairs of a cosine of 0.25 or more."""
    v, words = vectors(spark, d), F.array(*map(F.lit, ["ring", "bolt", "gear", "widget"]))
    text = F.concat("text", F.lit(" "), F.element_at(words, (F.col("doc_id") % 4 + 1).cast("int")))
    c = docs(spark, d).select(F.col("doc_id").alias("chunk"), text.alias("text"))
    n = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name"))
    return r.related(c, n, v, 0.25)
