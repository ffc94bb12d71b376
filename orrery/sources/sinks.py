"""Writing graphs, indexes and reports. A publication is a folder of its own and one small file says which is current, so a
reader, and a crash at any time, finds a whole publication: the old one or the new one."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.durable import file_system
from orrery.functions.expressions import hue, opacity, radius

#: Publications that stay beside the current one, for readers that have begun to read them.
KEPT = 1


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the current publication at ``path``; None if there is none."""
    fs, at = file_system(spark, f"{path.rstrip('/')}/CURRENT")
    if not fs.exists(at):
        return None
    return f"{path.rstrip('/')}/{spark._jvm.org.apache.commons.io.IOUtils.toString(fs.open(at), 'UTF-8').strip()}"


def publish(tables: dict[str, DataFrame], path: str, sort: dict[str, list[str]] | None = None, partition_by: dict[str, list[str]] | None = None) -> str:
    """Write ``tables`` as one publication at ``path`` and make it the current one; all of them change at once.

    The tables may be made from the publication they replace. The change is one rename of a small file over another.
    Publications older than the KEPT last ones are deleted, as are unfinished ones.
    """
    spark = next(iter(tables.values())).sparkSession
    path = path.rstrip("/")
    before = current(spark, path)
    name = f"v-{uuid.uuid4().hex}"
    for table, df in tables.items():
        keys = (sort or {}).get(table)
        out = df.sortWithinPartitions(*keys) if keys else df
        writer = out.write.partitionBy(*partition_by[table]) if (partition_by or {}).get(table) else out.write
        writer.parquet(f"{path}/{name}/{table}")
    jvm = spark._jvm
    fs, new = file_system(spark, f"{path}/CURRENT.{name}")
    stream = fs.create(new, True)
    stream.write(bytearray(name.encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsparkSession.sessionState().newHadoopConf())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(new), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT")), options)
    stay = {name, before.rpartition("/")[2] if before and KEPT else name}
    for status in fs.listStatus(jvm.org.apache.hadoop.fs.Path(path)):
        if status.getPath().getName().startswith("v-") and status.getPath().getName() not in stay:
            fs.delete(status.getPath(), True)
    return f"{path}/{name}"


def read_published(spark: SparkSession, path: str, table: str) -> DataFrame:
    at = current(spark, path)
    if at is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.parquet(f"{at}/{table}")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes by id and edges by (source, target, relation): range-partitioned, so the files in order are the total order."""
    order = {"nodes": ["id"], "edges": ["source", "target", "relation"]}
    publish({"nodes": nodes.repartitionByRange("id"), "edges": edges.repartitionByRange("source", "target", "relation")}, path, order)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of one publication, even if another one is made in between."""
    at = current(spark, path)
    if at is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.parquet(f"{at}/nodes"), spark.read.parquet(f"{at}/edges")


def content_hash(rows: DataFrame, volatile: tuple[str, ...] = ("generated_at",)) -> str:
    """16 hexadecimal digits that depend on the bag of rows only, whatever their order and partitions."""
    kept = [c for c in sorted(rows.columns) if c not in volatile]
    h = F.sha2(F.to_json(F.struct(*kept)), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)"))
    got = rows.agg(part(0).alias("a"), part(1).alias("b"), F.count(F.lit(1)).alias("n"))
    return got.select(F.substring(F.sha2(F.concat_ws("|", "a", "b", "n"), 256), 1, 16)).first()[0]


def mermaid(edges: DataFrame) -> DataFrame:
    """(line) of a diagram: one for each edge, ids without characters that the format gives a meaning."""
    safe = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9_]", "_")
    return edges.select(F.concat(F.lit("  "), safe("source"), F.lit(" -->|"), F.col("relation"), F.lit("| "), safe("target")).alias("line"))


def drawing(nodes: DataFrame, communities: int) -> DataFrame:
    """``nodes`` (id, community, degree) with hue and radius."""
    return nodes.withColumn("hue", hue(F.col("community"), F.lit(communities))).withColumn("radius", radius(F.col("degree")))


def edge_opacity(score: Column) -> Column:
    return opacity(score)


def pages(members: DataFrame) -> DataFrame:
    """(name, text): a page for each community (id, community, label), with file names that any system takes."""
    name = F.regexp_replace("community", r'[\\/:*?"<>|#^\[\]]', "_")
    body = F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("- [["), "label", F.lit("]]")))), "\n")
    return members.groupBy("community").agg(body.alias("b")).select(F.concat(name, F.lit(".md")).alias("name"), F.concat(F.lit("# "), "community", F.lit("\n\n"), "b").alias("text"))


def report(rows: DataFrame, title: str, most: int = 50) -> str:
    """A Markdown table of the first ``most`` rows of a small aggregate."""
    head = rows.limit(most).collect()
    cells = lambda r: "| " + " | ".join("" if v is None else str(v) for v in r) + " |"
    return "\n".join([f"# {title}", "", cells(rows.columns), cells(["---"] * len(rows.columns)), *map(cells, head), ""])


def retained(log: DataFrame, today: Column, days: int = 30) -> DataFrame:
    """Records (date) of the last ``days`` days."""
    return log.filter(F.datediff(today, F.col("date")) <= days)


def append_event(path: str, event: dict, on: bool = True) -> bool:
    """Append an event as a JSON line to a log of this process, if telemetry is on; whether it was written. Never raises:
    a log that can't be written must not stop the work that it is about."""
    import json

    if not on:
        return False
    try:
        with open(path, "a", encoding="utf-8") as f:
            f.write(json.dumps(event, ensure_ascii=False, sort_keys=True) + "\n")
    except (OSError, TypeError, ValueError):
        return False
    return True


def write_formats(rows: DataFrame, path: str, formats: tuple[str, ...] = ("parquet", "json", "csv")) -> list[str]:
    """The same rows in several formats, a folder for each; lists and maps are JSON text where a format has none."""
    out = []
    for name in formats:
        df = rows
        if name == "csv":
            df = rows.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in rows.dtypes])
        df.write.mode("overwrite").option("header", True).format(name).save(f"{path}/{name}")
        out.append(f"{path}/{name}")
    return out
