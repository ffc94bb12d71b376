"""Benchmark decontamination by SimHash of item-sized windows. DataFrame functions only.

A benchmark item of n words is compared with windows of n words of the documents, by the weighted Jaccard similarity
of their five-word shingles: the sum of the lesser counts over the sum of the greater ones. The steps:

1. Anchors. A window as similar as ``similarity`` to an item has at least N * 2s / (1 + s) of its N shingles in common
   with it, so only stretches of a document with that many of the item's shingles can hold one. A broadcast set of the
   items' shingle hashes (size checked) finds them inside each document's array, without exploding documents.
2. Windows. Of the item-sized windows that hold so many, the first of the most similar is found in one sweep over the
   item's shingles in the document (``swept``): each counts in an interval of starts, and sums of intervals are exact
   weighted similarities. Both bounds are necessary conditions, so nothing is lost, and the work grows with the shingles
   in common, not with their square.
3. SimHash. The 64-bit fingerprint of that window is looked up in a multi-index of the items: radius + 1 blocks of bits,
   of which one must be equal if at most ``radius`` bits differ. Blocks guarantee all fingerprints within the radius.
4. Verification: the exact weighted-shingle similarity of the window reaches ``similarity``.

A document of fewer words than the item is one window, the whole of it. Such documents, items of over 32,767 shingles, and
items and documents with a shingle more than once (one that differs and weighs much turns more bits than the radius)
aren't fingerprinted: their similarity is exact from the anchors, by ``swept``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_key, spare

#: Words of a shingle, least similarity, bits of the Hamming radius (where no shingle is repeated, at a similarity
#: of 0.8 about 10 of 64 bits differ, give or take 3), and item shingles of one pass (larger benchmarks take several passes; this bounds what is
#: broadcast).
SHINGLE, SIMILARITY, RADIUS, PASS = 5, 0.8, 20, 100_000


def words(text: Column) -> Column:
    """Lower-cased runs of other than space and \\t-\\r."""
    out = F.lower(text)
    for c in "\t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(out, " "), "")


def shingles(text: Column) -> Column:
    """Hashes of the shingles in order, repeats included; fewer words than a shingle: none; null: null."""

    def hashed(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))

    # the array of one binds the words, which would else be split anew for every shingle
    return F.transform(F.array(words(text)), lambda w: F.when(F.size(w) >= SHINGLE, hashed(w)).otherwise(F.array().cast("array<bigint>")))[0]


def fingerprint(hashes: str, n: str) -> Column:
    """SimHash of up to 32,767 hashes in array column ``hashes`` of size ``n``: bit b is set where over half of them
    have it set. A sum holds four 16-bit counters. SQL text, as a Column call for each of its terms takes long to plan."""
    sums = ", ".join(f"aggregate({hashes}, 0L, (a, x) -> a + (shiftrightunsigned(x, {g}) & {0x0001000100010001}L))" for g in range(16))
    bits = " | ".join(f"if((shiftrightunsigned(s[{b % 16}], {16 * (b // 16)}) & 65535L) * 2 > {n}, shiftleft(1L, {b}), 0L)" for b in range(64))
    return F.expr(f"transform(array(array({sums})), s -> {bits})[0]")


def block_values(fp: str, radius: int) -> list[str]:
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [f"(shiftrightunsigned({fp}, {a}) & {(1 << (b - a)) - 1}L)" for a, b in zip(cuts, cuts[1:], strict=False)]


def blocks(fp: str, radius: int) -> Column:
    """The radius + 1 blocks of fingerprint column ``fp``, as (block, value)."""
    return F.expr("array(" + ", ".join(f"named_struct('block', {i}, 'value', {v})" for i, v in enumerate(block_values(fp, radius))) + ")")


def first_equal(a: str, b: str, radius: int) -> Column:
    """Number of the first block in which two fingerprint columns agree."""
    return F.expr("coalesce(" + ", ".join(f"if({v} = 0, {i}, NULL)" for i, v in enumerate(block_values(f"({a} ^ {b})", radius))) + ")")


def items_of(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(_item, item_id, h, n, plain, fp, pass) of items that have a shingle; plain: none of them twice, and no more than a counter holds."""
    items = benchmark.select(F.col(item_col).alias("item_id"), shingles(F.col(text_col)).alias("h")).withColumn("n", F.size("h"))
    items = materialize(items.filter("n >= 1").dropDuplicates(["item_id", "h"]).withColumn("_item", F.monotonically_increasing_id()), "items")
    passes = max(1, -(-(items.agg(F.sum("n")).first()[0] or 0) // PASS))
    items = items.withColumn("plain", F.expr("n <= 32767 AND size(array_distinct(h)) = n"))
    return items.withColumn("fp", F.when(F.col("plain"), fingerprint("h", "n"))).withColumn("pass", F.pmod(F.xxhash64("h"), F.lit(passes)))


def swept(hits: DataFrame) -> DataFrame:
    """``hits`` with the greatest sum of the lesser counts over all windows, as ``best``, and its first ``start``.

    ``e`` holds (x, at, c) sorted: an item's shingle that stands c times in it, at a place of the document. Of a shingle
    at most c in a window count, so a place counts in the windows that hold it but not the c-th place before it. These
    starts are an interval, and the sum at a start is the number of intervals over it.
    """
    spans = """transform(e, (v, j) -> named_struct('hi', least(v.at, m - w),
        'lo', greatest(0, v.at - w + 1, if(j >= v.c, if(get(e, j - v.c).x = v.x, get(e, j - v.c).at + 1, 0), 0))))"""
    steps = f"sort_array(flatten(transform(filter({spans}, s -> s.lo <= s.hi), s -> array(named_struct('a', s.lo, 'd', 1), named_struct('a', s.hi + 1, 'd', -1)))))"
    # ends sort before beginnings at the same start, so a sum is never too great in between
    top = f"""aggregate({steps}, named_struct('run', 0, 'best', 0, 'start', 0), (t, s) -> named_struct(
        'run', t.run + s.d, 'best', greatest(t.best, t.run + s.d), 'start', if(t.run + s.d > t.best, s.a, t.start)))"""
    return hits.withColumn("top", F.expr(top)).select("_row", "_item", "item_id", "n", "w", "exact", "top.best", "top.start")


def one_pass(docs: DataFrame, items: DataFrame, similarity: float, radius: int) -> DataFrame:
    """Matches of ``docs`` (doc_id, text) with at most about PASS shingles of items."""
    every = sorted(r[0] for r in items.select(F.explode("h")).distinct().collect())  # at most about PASS numbers
    inside = ",".join(f"{x}L" for x in every if x != -(1 << 63))
    anchor = f"x -> x IN ({inside})"
    found = docs.select("doc_id", shingles(F.col("text")).alias("h")).filter(F.expr(f"exists(h, {anchor})"))
    found = found.withColumn("once", F.expr("size(array_distinct(h)) = size(h)"))
    found = materialize(found.withColumn("_row", F.monotonically_increasing_id()), "anchored")
    places = found.select("_row", "once", F.size("h").alias("m"), F.posexplode("h").alias("at", "x"))
    keys = items.select("_item", "item_id", "n", "plain", F.explode("h").alias("x")).groupBy("_item", "item_id", "n", "plain", "x").agg(F.count(F.lit(1)).cast("int").alias("c"))
    hits = places.join(F.broadcast(keys), "x").groupBy("_row", "once", "m", "_item", "item_id", "n", "plain").agg(F.sort_array(F.collect_list(F.struct("x", "at", "c"))).alias("e"))
    hits = hits.withColumn("w", F.least("n", "m"))  # a window's length
    need = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("n") + F.col("w")) - F.lit(1e-9)).cast("int")
    hits = materialize(hits.withColumn("need", F.greatest(need, F.lit(1))).filter("size(e) >= need"), "hits")
    exact = "m < n OR NOT plain OR NOT once"
    score = F.col("best") / (F.col("n") + F.col("w") - F.col("best"))
    likely = swept(hits.withColumn("exact", F.expr(exact))).withColumn("similarity", score).filter(F.col("similarity") >= similarity)
    likely = materialize(likely.join(found.select("_row", "doc_id"), "_row").select("_row", "doc_id", "item_id", "_item", "n", "w", "start", "similarity", "exact"), "likely")
    cut = likely.filter("NOT exact").join(found.select("_row", "h"), "_row").withColumn("h", F.expr("slice(h, start + 1, n)"))
    cut = materialize(cut.withColumn("fp", fingerprint("h", "n")).drop("h"), "windows")
    index = items.filter("plain").select("_item", "n", F.col("fp").alias("item_fp"), F.explode(blocks("fp", radius)).alias("b")).select("_item", "n", "item_fp", "b.*")
    probe = cut.select("*", F.explode(blocks("fp", radius)).alias("b")).select("*", "b.*").drop("b")
    near = probe.join(F.broadcast(index), ["_item", "n", "block", "value"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    # a pair that agrees in several blocks is taken in the first of them
    near = near.filter(F.col("block") == first_equal("fp", "item_fp", radius))
    columns = ["_row", "doc_id", "item_id", "n", "w", "start", "similarity"]
    both = near.select(columns).unionByName(likely.filter("exact").select(columns))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("best")
    out = both.groupBy("_row", "doc_id", "item_id", "n", "w").agg(best)
    return out.select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.s")).alias("start_word"), (F.col("w") + SHINGLE - 1).alias("n_words"))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): for every row of ``docs`` and item its best matching window.

    A window has the item's words, or all of a document that has fewer; ``n_words`` are the window's. Whole texts are searched. Rows with null text, texts or items of fewer than five words and empty tables match
    nothing; a null id is carried as null; a repeated row matches as often as it stands there; repeated items count
    once. Among equally similar windows the first is given. Other columns are not looked at.
    """
    items = materialize(items_of(benchmark, item_col, item_text_col), "index")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for (k,) in sorted(items.select("pass").distinct().collect()):
        found = one_pass(texts, items.filter(F.col("pass") == k).drop("pass"), similarity, radius)
        out = found if out is None else out.unionByName(found)
    if out is None:
        types = dict(items.dtypes) | {"doc_id": dict(texts.dtypes)["doc_id"]}
        return docs.sparkSession.createDataFrame([], f"doc_id {types['doc_id']}, item_id {types['item_id']}, similarity double, start_word int, n_words int")
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item; columns as they are, whatever their names.

    Rows are judged by their texts, read whole: null and empty ones and those of fewer than five words stay, repeated
    rows stay or go together, null ids are judged like others. Without benchmark items all rows stay; an empty table
    gives none.
    """
    key = spare(docs, "_key")
    texts = docs.select(row_key().alias("doc_id"), "text")
    bad = materialize(contaminated(texts, benchmark, similarity, radius).select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return docs.withColumn(key, row_key()).join(bad, key, "left_anti").select(*docs.columns)
