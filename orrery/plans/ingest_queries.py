"""Imports, budgets, Python imports and cohorts applied to views of the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import budgets, cohorts, ingest, pyimports

from .catalog import query
from .views import table


def first_word(chunks):
    """An entity for each chunk: its first word."""
    name = F.lower(F.regexp_extract("text", "([A-Za-z]+)", 1))
    return chunks.select(F.concat(F.lit("word:"), name).alias("entity_id"), "chunk_id", name.alias("name"), F.lit("word").alias("kind")).filter("name <> ''")


WORD = "lower(regexp_extract(text, '([A-Za-z]+)', 1))"


@query(f"""WITH bad AS (SELECT max(source) AS origin FROM documents), d AS (SELECT *, sha256(text) AS h FROM documents WHERE text IS NOT NULL),
b1 AS (SELECT h, arg_min(doc_id, doc_id) AS doc_id, min(doc_id) AS chunk_id, arg_min(text, doc_id) AS text FROM d WHERE lang IN ('en', 'fr') AND length(trim(text)) >= 20 GROUP BY h),
e1 AS (SELECT {WORD} AS name, min(chunk_id) AS chunk_id FROM b1 WHERE {WORD} <> '' GROUP BY 1),
inc AS (SELECT *, doc_id + 1000000 AS chunk_id FROM d WHERE source <> (SELECT origin FROM bad) AND lang <> 'en'),
kept AS (SELECT * FROM b1 WHERE doc_id NOT IN (SELECT doc_id FROM inc)),
fresh AS (SELECT h, min(chunk_id) AS chunk_id, arg_min(doc_id, chunk_id) AS doc_id, arg_min(text, chunk_id) AS text FROM inc WHERE length(trim(text)) >= 20 AND h NOT IN (SELECT h FROM kept) GROUP BY h),
e2 AS (SELECT {WORD} AS name, min(chunk_id) AS chunk_id FROM fresh WHERE {WORD} <> '' GROUP BY 1),
ek AS (SELECT e1.* FROM e1 JOIN b1 USING (chunk_id) WHERE b1.doc_id NOT IN (SELECT doc_id FROM inc) AND e1.name NOT IN (SELECT name FROM e2))
SELECT 'chunk' AS what, chunk_id::VARCHAR AS key, doc_id::VARCHAR AS value FROM kept UNION ALL SELECT 'chunk', chunk_id::VARCHAR, doc_id::VARCHAR FROM fresh
UNION ALL SELECT 'entity', 'word:' || name, chunk_id::VARCHAR FROM ek UNION ALL SELECT 'entity', 'word:' || name, chunk_id::VARCHAR FROM e2
UNION ALL SELECT 'source', source, CASE WHEN source = (SELECT origin FROM bad) THEN 'no connection' ELSE 'ok' END FROM d WHERE lang <> 'en' GROUP BY source
UNION ALL SELECT 'count', 'new_documents', (SELECT count(DISTINCT doc_id) FROM inc)::VARCHAR UNION ALL SELECT 'count', 'new_chunks', (SELECT count(*) FROM fresh WHERE h NOT IN (SELECT h FROM b1))::VARCHAR
UNION ALL SELECT 'count', 'new_entities', (SELECT count(*) FROM e2 WHERE name NOT IN (SELECT name FROM e1))::VARCHAR
UNION ALL SELECT 'count', 'total_chunks', ((SELECT count(*) FROM kept) + (SELECT count(*) FROM fresh))::VARCHAR UNION ALL SELECT 'count', 'total_entities', ((SELECT count(*) FROM ek) + (SELECT count(*) FROM e2))::VARCHAR""")
def ingest_batches(spark, d):
    """The texts of two languages, then those of three into what is there, of which one source fails."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    rows = lambda df, shift, error: df.select(F.col("source").alias("origin"), F.lit(0).alias("at"), "doc_id", F.col("lang").alias("title"), (F.col("doc_id") + shift).alias("chunk_id"), "text", error.alias("error"))
    one = ingest.prepare(None, rows(docs.filter("lang IN ('en', 'fr')"), 0, F.lit(None).cast("string")), first_word)
    bad = F.broadcast(docs.agg(F.max("source").alias("bad")))  # one row
    later = docs.filter("lang <> 'en'").join(bad)
    two = ingest.prepare({"documents": one.documents, "chunks": one.chunks, "entities": one.entities}, rows(later, 1000000, F.when(F.col("source") == F.col("bad"), "no connection")), first_word)
    what = lambda df, name, k, v: df.select(F.lit(name).alias("what"), k.cast("string").alias("key"), v.cast("string").alias("value"))
    counts = two.counts.unpivot([], two.counts.columns, "key", "value")
    return (
        what(two.chunks, "chunk", F.col("chunk_id"), F.col("doc_id")).unionByName(what(two.entities, "entity", F.col("entity_id"), F.col("chunk_id")))
        .unionByName(what(two.sources, "source", F.col("origin"), F.coalesce("reason", F.lit("ok")))).unionByName(what(counts, "count", F.col("key"), F.col("value")))
    )


@query("""WITH RECURSIVE o AS (SELECT source AS grp, doc_id % 3 AS priority, doc_id AS id, n_chars AS cost, row_number() OVER (PARTITION BY source ORDER BY doc_id % 3, doc_id) AS r FROM documents
WHERE NOT coalesce(len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 500)) / len(string_split(text, chr(10))) > 0.3, false)),
w(grp, r, spent, priority, id, cost, fits) AS (SELECT DISTINCT grp, 0::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, false FROM o
UNION ALL SELECT w.grp, o.r, CASE WHEN w.spent + o.cost <= 20000 THEN w.spent + o.cost ELSE w.spent END, o.priority, o.id, o.cost, w.spent + o.cost <= 20000 FROM w JOIN o ON o.grp = w.grp AND o.r = w.r + 1)
SELECT grp, priority, id, cost, spent FROM w WHERE fits""")
def greedy_budget(spark, d):
    """The texts of each source that fit 20,000 characters, skipping those that don't and those that look generated."""
    docs = table(spark, d, "documents")
    items = docs.filter(~F.coalesce(budgets.minified(F.col("text")), F.lit(False)))
    return budgets.fitting(items.select(F.col("source").alias("grp"), (F.col("doc_id") % 3).alias("priority"), F.col("doc_id").alias("id"), F.col("n_chars").alias("cost")), 20000)


@query("""WITH p AS (SELECT *, lower(split_part(p_name, ' ', 2)) AS m, 'b' || p_size % 5 AS pk FROM part),
f AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN pk || '/' || m || '.py' WHEN 1 THEN pk || '/' || m || '/__init__.py' WHEN 2 THEN pk || '/__init__.py' ELSE m || '.py' END AS path FROM p),
i AS (SELECT pk || '/sub/mod' || p_size || '.py' AS file, pk, m, p_partkey % 9 AS k, CASE p_partkey % 9 WHEN 0 THEN '..' || m WHEN 1 THEN '.' || m WHEN 2 THEN '..' WHEN 3 THEN '...' || m WHEN 4 THEN '....' || m WHEN 5 THEN pk || '.' || m WHEN 6 THEN m WHEN 7 THEN 'os.path' ELSE pk END AS specifier FROM p),
c AS (SELECT *, CASE k WHEN 0 THEN pk || '/' || m WHEN 1 THEN pk || '/sub/' || m WHEN 2 THEN pk WHEN 3 THEN m WHEN 5 THEN pk || '/' || m WHEN 6 THEN m WHEN 8 THEN pk END AS base FROM i),
r AS (SELECT file, specifier, k, CASE WHEN k <> 2 AND base || '.py' IN (SELECT path FROM f) THEN base || '.py' WHEN base || '/__init__.py' IN (SELECT path FROM f) THEN base || '/__init__.py' END AS resolved FROM c)
SELECT file, specifier, resolved, CASE WHEN k = 7 THEN 'external' WHEN resolved IS NULL THEN 'unresolved' WHEN k < 5 THEN 'relative-sibling' WHEN ends_with(resolved, '__init__.py') THEN 'package-init' ELSE 'module' END AS kind FROM r""")
def python_import_resolution(spark, d):
    """Parts as modules, packages and imports of a project, in nine forms."""
    p = table(spark, d, "part").withColumn("m", F.lower(F.split("p_name", " ")[1])).withColumn("pk", F.concat(F.lit("b"), (F.col("p_size") % 5).cast("string")))
    k = F.col("p_partkey")
    path = F.when(k % 4 == 0, F.concat("pk", F.lit("/"), "m", F.lit(".py"))).when(k % 4 == 1, F.concat("pk", F.lit("/"), "m", F.lit("/__init__.py"))).when(k % 4 == 2, F.concat("pk", F.lit("/__init__.py"))).otherwise(F.concat("m", F.lit(".py")))
    dotted = lambda n: F.concat(F.lit("." * n), "m")
    forms = F.array(dotted(2), dotted(1), F.lit(".."), dotted(3), dotted(4), F.concat("pk", F.lit("."), "m"), F.col("m"), F.lit("os.path"), F.col("pk"))
    file = F.concat("pk", F.lit("/sub/mod"), F.col("p_size").cast("string"), F.lit(".py"))
    return pyimports.resolve_python_imports(p.select(file.alias("file"), F.element_at(forms, (k % 9 + 1).cast("int")).alias("specifier")), p.select(path.alias("path")))


RUNS = "runs AS (SELECT p_type AS cohort, p_brand AS task, CASE WHEN p_partkey % 7 <> 0 THEN p_size > 25 END AS passed, CASE WHEN p_partkey % 5 <> 0 THEN p_size * 10 END AS tokens FROM part)"


def runs(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(F.col("p_type").alias("cohort"), F.col("p_brand").alias("task"), F.when(k % 7 != 0, F.col("p_size") > 25).alias("passed"), F.when(k % 5 != 0, F.col("p_size") * 10).alias("tokens"))


@query(f"""WITH {RUNS}, s AS (SELECT cohort, count(*) AS runs, count(passed) AS judged, count(*) - count(passed) AS unjudged, count(*) FILTER (passed) AS passes, avg(passed::INT) AS rate,
avg(tokens) FILTER (passed) AS tokens, count(*) FILTER (passed AND tokens IS NULL) AS without_tokens FROM runs GROUP BY cohort), b AS (SELECT rate AS r0, tokens AS t0 FROM s WHERE cohort = 'PROMO')
SELECT s.*, CASE WHEN r0 > 0 THEN rate / r0 END AS lift, CASE WHEN t0 > 0 THEN tokens / t0 END AS token_ratio FROM s LEFT JOIN b ON true""")
def cohort_stats(spark, d):
    return cohorts.cohort_stats(runs(spark, d), "PROMO")


@query(f"""WITH {RUNS}, c AS (SELECT task, cohort, count(*) FILTER (passed) || '/' || count(passed) AS cell FROM runs WHERE passed IS NOT NULL GROUP BY ALL)
SELECT * FROM (SELECT DISTINCT task FROM runs) LEFT JOIN (PIVOT c ON cohort USING max(cell) GROUP BY task) USING (task)""")
def cohort_task_matrix(spark, d):
    return cohorts.cohort_matrix(runs(spark, d))


#: Pairs of old and new code by language, and what is to be found out about them.
CHANGES = [
    ("typescript", "const u = 'http://a.b';", "const u = 'http://a.c';", None),
    ("typescript", "f(a, b); // note", "f(a,  b)", "formatting"),
    ("typescript", "x = [1, 2,]; /* old */", "x = [1, 2]", "formatting"),
    ("typescript", "import { a } from 'x';\nimport { b } from 'y';\ngo()", "import { b } from 'y';\nimport { a } from 'x';\ngo()", "imports"),
    ("javascript", "import { a } from 'x'; go()", "import { a } from 'x'; stop()", None),
    ("javascript", "s = `/* ${a} */`", "s = `/* ${b} */`", None),
    ("python", "x = '# no comment'", "x = '# another'", None),
    ("python", "x = 1  # one", "x = 1  # uno", "formatting"),
    ("python", "import os\nimport re\nrun()", "import re\nimport os\nrun()", "imports"),
    ("go", 'a := "//x" // y', 'a := "//x"', "formatting"),
    ("java", "int a = 1;", "int a = 1", None),
    ("rust", "use a::b;\nuse c::d;", "use c::d;\nuse a::b;", "imports"),
    (None, "", "x", None),
]


def _literal(v):
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


@query("WITH c(k, language, old, new, reason) AS (VALUES " + ", ".join(f"({i}, {', '.join(map(_literal, c))})" for i, c in enumerate(CHANGES)) + f""")
SELECT p_partkey AS id, language, CASE WHEN old = '' THEN NULL WHEN p_partkey % 3 = 0 AND k <> 12 THEN CASE WHEN reason IS NULL OR k IN (3, 8, 11) THEN reason ELSE 'formatting' END ELSE reason END AS reason FROM part JOIN c ON p_partkey % {len(CHANGES)} = k""")
def drift_noise_by_language(spark, d):
    """Parts as changes of code in six languages, of which a third have a blank line more on either side."""
    from orrery.operators import noise

    forms = F.array(*[F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(("language", "old", "new"), c, strict=False)]) for c in CHANGES])
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(k.alias("id"), F.element_at(forms, (k % len(CHANGES) + 1).cast("int")).alias("c")).select("id", "c.*")
    blank = (F.col("id") % 3 == 0) & (F.length("old") > 0)
    rows = rows.withColumn("old", F.when(blank, F.concat(F.lit("\n\n"), "old")).otherwise(F.col("old"))).withColumn("new", F.when(blank, F.concat("new", F.lit("\n"))).otherwise(F.col("new")))
    return noise.noise(rows).select("id", "language", "reason")
