"""Mixing sources to target weights by systematic sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, lookup, materialize, prefix_sums, row_key, spare

#: Expected copies and offsets are whole numbers of 1/ONE, so that running sums are exact.
ONE = 1 << 24


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def levels(sources: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """``sources`` (key, source, source_size) with ``target`` added.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` of all sizes; a target stops at
    ``cap`` times its source's size and the excess goes to the others by weight. In order of cap / weight the level
    reached when all smaller ratios are capped, (T - capped sizes) / (weights left), rises up to the true level and
    falls after it, so its maximum is the level, and a target is the lesser of the cap and weight times level.
    """
    weight = F.expr("CASE " + " ".join(f"WHEN _rank % {len(weights)} = {i} THEN {w}" for i, w in enumerate(weights)) + " END").cast("long")
    ranked = prefix_sums(sources.withColumn("_last", F.col("source").isNull()).withColumn("_one", F.lit(1).cast("long")), ["_last", "source"], {"_rank": "_one"})
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * cap)
    ranked = materialize(ranked.withColumn("_ratio", F.col("_cap") / F.col("_w")), "weights")
    size, weighed = ranked.agg(F.sum("source_size"), F.sum("_w")).first()
    filled = prefix_sums(ranked, ["_ratio", "key"], {"_c": "_cap", "_b": "_w"})
    level = filled.agg(F.max((F.lit(float(share * (size or 0))) - F.col("_c")) / (F.lit(weighed or 1) - F.col("_b")))).first()[0] or 0.0
    return ranked.withColumn("target", F.least(F.col("_cap").cast("double"), F.col("_w") * F.lit(level))).select(*sources.columns, "target")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: int = 2,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of every row.

    Every document of a source is expected target / source_size times. Rows of a source are laid out by size and id,
    their expected copies are prefix-summed, the source's offset (of its name and ``seed``, so reruns agree) is added,
    and a row is taken once for each whole number that its stretch crosses: at most ``cap`` times. The layout by size
    spreads the picks over all sizes, so the words taken come near the target.
    Null text has size 0; null source is a source of its own, last; a source of size 0 has target 0 and nothing is
    taken of it. Null ids and repeated rows count like any other row. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"))
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    laid = prefix_sums(rows.withColumn("_one", F.lit(1).cast("long")), ["key", "size", "doc_id"], {"_row": "_one"}, group="key")
    laid = materialize(laid, "mixed")
    sources = laid.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = levels(materialize(sources, "sources"), weights, share, cap)
    step = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * ONE)).otherwise(0).cast("long")
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce("source", F.lit("")))), 1, 6), 16, 10).cast("long")
    sources = sources.select("key", "n", "source_size", "target", step.alias("_step"), start.alias("_start"))
    out = lookup(laid.select("doc_id", "size", "key", "_row"), sources, "key", "n")
    out = out.withColumn("copies", F.expr(f"(_start + (_row + 1) * _step) div {ONE} - (_start + _row * _step) div {ONE}"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, seed: str = "mix") -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken; columns as they are, whatever their names.

    Of rows that repeat in id and text one stands for all, with the copies of all. Documents without words (null and
    empty texts among them) are drawn like others and add nothing to the size; a source of such documents only is
    left out. Null sources are one source, null ids are drawn like others, very long texts count whole, ties in size
    are laid out by id. An empty table gives no rows.
    """
    key, n = spare(docs, "_key"), spare(docs, "_copies")
    taken = mix(docs.select(row_key().alias("doc_id"), "text", "source"), weights, share, cap, seed)
    taken = taken.filter("copies > 0").groupBy(F.col("doc_id").alias(key)).agg(F.sum("copies").alias(n), F.count(F.lit(1)).alias("rows"))
    taken = materialize(taken, "taken")
    keyed = docs.withColumn(key, row_key())
    out = keyed.join(taken.filter("rows = 1").drop("rows"), key)
    repeated = taken.filter("rows > 1").drop("rows")
    if not repeated.isEmpty():
        out = out.unionByName(keyed.join(repeated, key).dropDuplicates([key]))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))).alias(spare(docs, "_copy"))
    return out.select(*docs.columns, copies).select(*docs.columns)
