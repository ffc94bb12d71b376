"""Which texts hold a string, by equi-joins on short runs of characters instead of a comparison of all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a run at most; shorter strings are looked up by all of their characters.
GRAM = 3
HAN = r"\p{IsHan}"


def runs(text: Column, n: int) -> Column:
    """The different runs of ``n`` characters of a text; none if it is shorter."""
    at = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(n))))


def containing(rows: DataFrame, text: str, asked: DataFrame, needle: str) -> DataFrame:
    """All pairs of ``rows`` and ``asked`` (which share no column) such that ``text`` contains ``needle``, as they are written.

    Each needle is looked up by that of its runs which the fewest rows have, and what is found is compared exactly. Null
    and empty needles find nothing.
    """
    wanted = asked.filter(F.length(needle) > 0).select(F.col(needle).alias("_needle")).distinct().withColumn("_n", F.least(F.length("_needle"), F.lit(GRAM)))
    pairs = None
    for n in range(1, GRAM + 1):
        mine = wanted.filter(F.col("_n") == n).select("_needle", F.explode(runs(F.col("_needle"), n)).alias("_gram"))
        # exploded rows are many more than their files' size tells: they are never broadcast
        held = rows.filter(F.length(text) >= n).withColumn("_gram", F.explode(runs(F.col(text), n))).hint("merge")
        often = held.join(mine.select("_gram").distinct(), "_gram", "left_semi").groupBy("_gram").agg(F.count(F.lit(1)).alias("_rows"))
        # a needle with a run that no row has is in none of them
        counted = mine.join(often, "_gram", "left").groupBy("_needle").agg(F.min(F.struct(F.coalesce("_rows", F.lit(0)).alias("k"), "_gram")).alias("_b"))
        best = counted.filter("_b.k > 0").select("_needle", F.col("_b._gram").alias("_gram"))
        met = held.join(best, "_gram").filter(F.col(text).contains(F.col("_needle"))).drop("_gram")
        pairs = met if pairs is None else pairs.unionByName(met)
    return pairs.join(asked, F.col("_needle") == F.col(needle)).drop("_needle")


def han_postings(chunks: DataFrame) -> DataFrame:
    """(gram, chunk_id, at): every Han character and pair of neighbours of ``chunks`` (chunk_id, text), and its first place."""
    text = F.col("text")
    of = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(f"{HAN}+"), F.lit(0)), lambda r: F.concat(runs(r, 1), runs(r, 2))))
    return chunks.filter(text.rlike(HAN)).select("chunk_id", "text", F.explode(F.array_distinct(of)).alias("gram")).select("gram", "chunk_id", (F.instr("text", F.col("gram")) - 1).alias("at"))


def holding_han(chunks: DataFrame, asked: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id) of chunks that hold the text of ``asked`` (query_id, wanted), which has a Han character.

    One or two characters are read from the postings alone; of longer texts, postings of a pair (or else a character) say
    which chunks are read. ``postings`` are those of ``han_postings``, stored or made here.
    """
    postings = han_postings(chunks) if postings is None else postings
    pair = F.regexp_extract("wanted", f"{HAN}{{2}}", 0)
    gram = F.when(pair != "", pair).otherwise(F.regexp_extract("wanted", HAN, 0))
    found = asked.select("query_id", "wanted", gram.alias("gram")).join(postings.select("gram", "chunk_id"), "gram")
    whole = found.filter(F.col("wanted") == F.col("gram")).select("query_id", "chunk_id")
    part = found.filter(F.col("wanted") != F.col("gram")).join(chunks.select("chunk_id", "text"), "chunk_id").filter(F.col("text").contains(F.col("wanted")))
    return whole.unionByName(part.select("query_id", "chunk_id"))
