"""Architecture and runtime views of the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import architecture as a
from orrery.sources.files import docker_instructions

from .catalog import query
from .views import EDGES_SQL, NODES_SQL, edges, nodes, table


def images(spark, d):
    """A Dockerfile of two or three stages for each supplier."""
    k = F.col("s_suppkey")
    n = k.cast("string")
    text = F.concat(
        F.lit("# image\nFROM base:"), (k % 4).cast("string"), F.lit(" AS build\nENV MODE=fast LEVEL="), n, F.lit("\nENV MODE slow\nRUN make \\\n  all\n"),
        F.when(k % 2 == 0, F.concat(F.lit("FROM --platform=x tool:"), n, F.lit("\nCOPY --from=build /a /b\nVOLUME [\"/data\", \"/log\"]\n"))).otherwise(""),
        F.lit("FROM slim\nCOPY --from=0 /a /b\nCOPY --from=ext:1 /c /d\nWORKDIR /one\nWORKDIR /two\nEXPOSE 80 "), (8000 + k % 3).cast("string"), F.lit("\nEXPOSE 80\nCMD [\"run\"]\n"),
    )
    return table(spark, d, "supplier").select(F.concat(F.lit("s"), n, F.lit("/Dockerfile")).alias("path"), text.alias("text"))


STAGES = """s AS (SELECT s_suppkey AS k, 's' || s_suppkey || '/Dockerfile' AS path FROM supplier),
st AS (SELECT path, 0 AS index, 'build' AS name, 'base:' || k % 4 AS base, 'build' AS role, []::VARCHAR[] AS ports, []::VARCHAR[] AS volumes, []::VARCHAR[] AS copies_from, 'LEVEL=' || k || ',MODE=slow' AS environment, NULL AS workdir, NULL AS command, k FROM s UNION ALL
SELECT path, 1, 'stage-2', 'tool:' || k, 'build', [], ['/data', '/log'], ['build'], '', NULL, NULL, k FROM s WHERE k % 2 = 0 UNION ALL
SELECT path, 2 - k % 2, 'stage-' || (3 - k % 2), 'slim', 'runtime', ['80', (8000 + k % 3)::VARCHAR], [], ['build', 'ext:1'], '', '/two', '["run"]', k FROM s)"""


@query(f"WITH {STAGES} SELECT * EXCLUDE (k, index), index::INT AS index FROM st")
def runtime_stages(spark, d):
    rows = a.build_stages(docker_instructions(images(spark, d)))
    env = F.array_join(F.transform(F.map_entries("environment"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return rows.withColumn("environment", env).drop("entrypoint")


def architecture(spark, d):
    """Facts of the graph, of the images' stages, and of suppliers that run them."""
    kinds = nodes(spark, d).select(F.col("id").alias("source"), "kind")
    told = edges(spark, d).filter("relation <> 'references'").join(kinds, "source")
    graph = told.select(F.col("source").alias("element"), "kind", "relation", "target", F.col("confidence").alias("evidence"))
    stages = a.build_stages(docker_instructions(images(spark, d)))
    runs = stages.filter("role = 'runtime'").select(F.concat(F.lit("supplier:"), F.regexp_extract("path", r"s(\d+)", 1)).alias("element"), F.lit("deployed").alias("kind"), F.lit("runs").alias("relation"), F.concat_ws("#", "path", "name").alias("target"), F.col("path").alias("evidence"))
    return a.facts({"graph": graph, "images": a.stage_facts(stages), "runtime": runs})


FACTS = f"""{NODES_SQL}, {EDGES_SQL}, {STAGES}, raw AS (SELECT source AS element, kind, relation, target, confidence AS evidence, 'graph' AS source FROM edges JOIN nodes ON id = source WHERE relation <> 'references' UNION ALL
SELECT path || '#' || name, role || '-stage', 'built-from', base, path, 'images' FROM st UNION ALL SELECT path || '#' || name, role || '-stage', 'copies-from', unnest(copies_from), path, 'images' FROM st UNION ALL
SELECT path || '#' || name, role || '-stage', 'exposes', unnest(ports), path, 'images' FROM st UNION ALL SELECT 'supplier:' || k, 'deployed', 'runs', path || '#' || name, path, 'runtime' FROM st WHERE role = 'runtime'),
fa AS (SELECT element, (SELECT min(kind) FROM raw r WHERE r.element = raw.element) AS kind, relation, target, list_sort(list_distinct(list(evidence))) AS evidence, list_sort(list_distinct(list(source))) AS sources FROM raw GROUP BY element, relation, target)"""


@query(f"WITH {FACTS} SELECT element, kind, relation, target, array_to_string(evidence, ',') AS evidence, array_to_string(sources, ',') AS sources FROM fa")
def architecture_facts(spark, d):
    return architecture(spark, d).withColumn("evidence", F.array_join("evidence", ",")).withColumn("sources", F.array_join("sources", ","))


@query(f"""WITH {FACTS}, own AS (SELECT element, kind, list_sort(list_distinct(flatten(list(sources)))) AS sources, count(relation) AS relations FROM fa GROUP BY element, kind)
SELECT element, kind, array_to_string(sources, ',') AS sources, relations FROM own UNION ALL
SELECT target, 'external', array_to_string(list_sort(list_distinct(flatten(list(sources)))), ','), 0 FROM fa WHERE target NOT IN (SELECT element FROM own) GROUP BY target""")
def architecture_elements(spark, d):
    return a.elements(architecture(spark, d)).withColumn("sources", F.array_join("sources", ","))


@query(f"""WITH {FACTS}, m(view, relation) AS (VALUES ('system-context', 'uses'), ('deployment', 'runs'), ('deployment', 'exposes'), ('deployment', 'built-from'), ('deployment', 'copies-from'), ('component', 'contains'), ('component', 'depends-on'), ('component', 'calls')),
v AS (SELECT view, element, target FROM fa JOIN m USING (relation)), e AS (SELECT view, element AS x FROM v UNION ALL SELECT view, target FROM v)
SELECT n.view, (SELECT count(*) FROM v WHERE v.view = n.view) > 0 AS available, (SELECT count(DISTINCT x) FROM e WHERE e.view = n.view) AS elements, (SELECT count(*) FROM v WHERE v.view = n.view) AS relations FROM (SELECT DISTINCT view FROM m) n""")
def architecture_overview(spark, d):
    return a.overview(architecture(spark, d))
