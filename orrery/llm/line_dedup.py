"""Boilerplate lines by site-relative frequency. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialize

#: A line goes if it stands on more than RATIO of its host's pages and on SEEN of them or more.
RATIO, SEEN = 0.3, 2
#: What ends a line of a page, and what holds no text.
BREAKS = r"(?i)<(?:/?(?:p|div|li|ul|ol|h[1-6]|nav|article|section|header|footer|title|table|tr|td|th|body|head|html|main|aside|form|blockquote|pre)\b[^>]*|br[^>]*)>"
SILENT = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
TAG, SPACE, HOST = r"<[^>]*>", r"[\x20\x09-\x0D]+", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def lines(html: Column) -> Column:
    """Text lines of a page, trimmed, in order; empty lines are none; null: no lines."""
    text = F.regexp_replace(F.regexp_replace(html, SILENT, ""), SPACE, " ")
    text = F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), TAG, "")
    return F.coalesce(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def drop_boilerplate(
    pages: DataFrame, ratio: float = RATIO, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(page_id, host, n_lines, n_dropped, text) of every row: the lines left, joined by line feeds.

    Pages are grouped by host; a line's frequency is the number of the host's pages that contain it, once or more
    often, over the host's pages; hosts of any size, but a line of one page only stays. Null html has no lines; a url without a host belongs to no site and loses nothing;
    repeated rows count as pages; null ids are kept; an empty table gives no rows; other columns are not looked at.

    Lines are counted as hashes by partial sums, so a hot host or line never gathers. A host has at most (its mean
    number of lines a page) / ``ratio`` boilerplate lines, so its set of them is small and goes to the pages as an
    array; pages of hot hosts meet it without a shuffle.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), lines(F.col(html_col)).alias("lines"))
    rows = materialize(rows, "lines")
    each = rows.filter("host <> ''").select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("line"))
    often = each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SEEN)
    totals = materialize(rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "hosts")
    sites = totals.filter("host <> ''")
    # a host has at most (its lines) / SEEN such rows: weigh it by them, so a hot host is joined in place
    often = materialize(often, "often")
    weighed = often.groupBy("host").agg(F.count(F.lit(1)).alias("w")).join(sites, "host")
    boiler = lookup(often, weighed, "host", "w").filter(F.col("n") > F.col("pages") * ratio)
    sets = totals.join(boiler.groupBy("host").agg(F.collect_set("line").alias("drop")), "host", "left")
    sets = sets.withColumn("drop", F.coalesce("drop", F.array().cast("array<bigint>")))
    out = lookup(rows, materialize(sets, "boilerplate"), "host", "pages")
    out = out.withColumn("kept", F.expr("filter(lines, x -> NOT array_contains(drop, xxhash64(x)))"))
    n = F.size("lines").cast("long")
    return out.select("page_id", "host", n.alias("n_lines"), (n - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text"))
