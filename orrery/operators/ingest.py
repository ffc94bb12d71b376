"""Imports into a knowledge base in two phases: a plan that changes nothing, and a commit that changes all tables at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.durable import written
from orrery.operators.knowledge import heuristic_entities
from orrery.sources.sinks import current, publish

#: Fixed value: trimmed texts of fewer characters are no chunks.
SHORTEST = 20


@dataclass
class IngestPlan:
    """What a base would hold after an import, how each source fared, and one row of counts."""

    documents: DataFrame  # doc_id, title
    chunks: DataFrame  # chunk_id, doc_id, text, origin
    entities: DataFrame  # entity_id, doc_id, chunk_id, name, kind
    sources: DataFrame  # origin, ok, reason
    counts: DataFrame  # new_documents, new_chunks, new_entities, total_chunks, total_entities


def entities_of(chunks: DataFrame) -> DataFrame:
    """(entity_id, chunk_id, name, kind) that heuristics find in chunks (chunk_id, text)."""
    found = heuristic_entities(chunks.select(F.col("chunk_id").alias("section"), "text"))
    return found.select(F.concat_ws(":", "kind", "name").alias("entity_id"), F.col("section").alias("chunk_id"), "name", "kind")


def prepare(base: dict[str, DataFrame] | None, incoming: DataFrame, extract: Callable[[DataFrame], DataFrame] = entities_of, least: int = SHORTEST) -> IngestPlan:
    """The plan of importing ``incoming`` (origin, at, doc_id, title, chunk_id, text, error) into ``base`` (documents, chunks,
    entities; None: an empty one).

    A source (origin) with an error in any row fails as a whole and alone. Documents imported again replace their chunks
    and entities; a text that stays or came before (by ``at``, then chunk) doesn't come again. Entities are merged by id,
    imported ones win, of equal ones the first chunk's. ``new_`` counts what the base didn't hold before at all, so the
    same import twice counts nothing the second time.
    """
    sources = incoming.groupBy("origin").agg(F.max("error").alias("reason")).select("origin", F.col("reason").isNull().alias("ok"), "reason")
    good = written(incoming.join(sources.filter("ok").select("origin"), "origin", "left_semi").withColumn("_h", F.sha2("text", 256)), "ingest")
    docs = good.groupBy("doc_id").agg(F.max_by("title", "at").alias("title"))
    if base is None:
        nothing = good.filter("false")
        base = {"documents": docs.filter("false"), "chunks": nothing.select("chunk_id", "doc_id", "text", "origin"), "entities": extract(nothing).withColumn("doc_id", F.lit(None).cast(dict(good.dtypes)["doc_id"]))}
    stays = lambda name: base[name].join(docs.select("doc_id"), "doc_id", "left_anti")
    kept = stays("chunks").withColumn("_h", F.sha2("text", 256))
    first = good.filter(F.length(F.trim("text")) >= least).groupBy("_h").agg(F.min(F.struct("at", "chunk_id", "doc_id", "origin", "text")).alias("c")).select("c.chunk_id", "c.doc_id", "c.text", "c.origin", "_h")
    fresh = written(first.join(kept.select("_h"), "_h", "left_anti"), "fresh")
    before = base["chunks"].select(F.sha2("text", 256).alias("_h")).distinct()
    found = extract(fresh.select("chunk_id", "text")).join(fresh.select("chunk_id", "doc_id"), "chunk_id")
    found = written(found.groupBy("entity_id").agg(F.min(F.struct("chunk_id", "doc_id", "name", "kind")).alias("e")).select("entity_id", "e.*"), "entities")
    fields = ["entity_id", "doc_id", "chunk_id", "name", "kind"]
    entities = stays("entities").join(found.select("entity_id"), "entity_id", "left_anti").select(fields).unionByName(found.select(fields))
    chunks = kept.select("chunk_id", "doc_id", "text", "origin").unionByName(fresh.select("chunk_id", "doc_id", "text", "origin"))
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    counts = one(docs, "new_documents")  # rows of one number each
    for more in (
        one(fresh.join(before, "_h", "left_anti"), "new_chunks"), one(found.join(base["entities"].select("entity_id"), "entity_id", "left_anti"), "new_entities"),
        one(chunks, "total_chunks"), one(entities, "total_entities"),
    ):
        counts = counts.join(F.broadcast(more))
    return IngestPlan(stays("documents").select("doc_id", "title").unionByName(docs), chunks, entities, sources, counts)


def open_base(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """The tables published at ``path``, None if nothing is; a publication that can't be read is an error, not an empty base."""
    at = current(spark, path)
    if at is None:
        return None
    tables = {}
    for name in ("documents", "chunks", "entities"):
        try:
            tables[name] = spark.read.parquet(f"{at}/{name}")
            tables[name].agg(F.max(F.xxhash64(*tables[name].columns))).collect()
        except Exception as e:
            raise ValueError(f"{at}/{name} can't be read; the base stays as it is") from e
    return tables


def commit(plan: IngestPlan, path: str) -> str:
    """Publish a plan's tables: readers find the old base or the new one."""
    return publish({"documents": plan.documents, "chunks": plan.chunks, "entities": plan.entities}, path)


def ingest_into(path: str, incoming: DataFrame, extract: Callable[[DataFrame], DataFrame] = entities_of) -> IngestPlan:
    """Import into the base at ``path``: planned and committed, unless its tables can't be read or no source is good."""
    plan = prepare(open_base(incoming.sparkSession, path), incoming, extract)
    if not plan.sources.filter("ok").isEmpty():
        commit(plan, path)
    return plan
