"""Continuous operation: change events coalesced into sessions, and graphs kept up to date by micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orrery.operators.graph import merge_incremental
from orrery.operators.statistics import sessions
from orrery.sources.sinks import read_graph, write_graph

#: Changes below these are not reported.
IGNORE = r"(^|/)(node_modules|\.git|dist|build|__pycache__)(/|$)|~$|\.swp$"


def change_stream(spark: SparkSession, path: str, schema: str, time: str = "ts") -> DataFrame:
    """A stream of change records (JSON lines files arriving in ``path``)."""
    return spark.readStream.schema(schema).json(path).withColumn(time, F.col(time).cast("timestamp"))


def debounced(changes: DataFrame, quiet: str = "3 seconds", late: str = "10 minutes", key: str = "root", time: str = "ts", item: str = "path") -> DataFrame:
    """One row for each burst of changes of a root once it was quiet for ``quiet``; later than ``late`` is dropped by the watermark."""
    kept = changes.filter(~F.col(item).rlike(IGNORE)).withWatermark(time, late)
    by = kept.groupBy(F.col(key), F.session_window(time, quiet).alias("w"))
    return by.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(item)).alias("items")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "items")


def keep_graph(changes: DataFrame, graph: str, derive: Callable[[DataFrame], tuple[DataFrame, DataFrame]], checkpoint: str) -> StreamingQuery:
    """Each micro-batch: the changed files' nodes and edges are derived anew and merged into the graph at ``graph``.

    Nodes and edges change at once. A batch that is run again after a failure merges the same files again, with the same result.
    """

    def merge(batch: DataFrame, _: int) -> None:
        changed = batch.select(F.col("path").alias("file")).distinct()
        if changed.isEmpty():
            return
        nodes, edges = read_graph(batch.sparkSession, graph)
        write_graph(*merge_incremental(nodes, edges, *derive(changed), changed), graph)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = ["change_stream", "debounced", "keep_graph", "sessions"]
