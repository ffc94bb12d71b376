"""Contiguous shards of equal bytes from global prefix sums. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prefix_sums


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, position) of every row: law ``bytes``.

    Rows are laid out by (MD5 of the text, id), so equal texts (a group of copies) lie side by side in one shard or,
    where a cut falls inside the group, in neighbouring ones. Every row has an exclusive prefix sum of sizes
    (``position``) over that layout, made of per-partition totals; its shard is that of its middle byte when the whole
    is cut at ``shards`` equal targets. ``slot`` counts rows within a shard from 0.
    Null text: size 8, null text_crc32, laid out first. Null ids come first within a group. Repeated rows each get a
    slot. An empty table gives no rows; fewer rows than shards leave shards empty. Other columns are not looked at.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5(text.cast("binary")), F.lit("")).alias("_key"),
        F.lit(1).cast("long").alias("_one"),
    )
    laid = prefix_sums(rows, ["_key", "doc_id"], {"position": "size", "_row": "_one"})
    laid = materialize(laid, "laid")
    total = laid.agg(F.sum("size")).first()[0] or 1
    cut = F.expr(f"least({shards - 1}, cast((2 * position + size) * {shards} div {2 * total} as int))")
    laid = laid.withColumn("shard", cut)
    first = laid.groupBy("shard").agg(F.min("_row").alias("_first"))  # one row for each shard
    out = laid.join(F.broadcast(first), "shard")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_row") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "position",
    )
