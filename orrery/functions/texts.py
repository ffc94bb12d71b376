"""Text, path and time helpers as columns, and what needs a scan of characters as an Arrow function."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order of request methods, and path segments that name no subject.
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "HEAD", "TRACE", "ALL")
GENERIC = ("api",)

# --- normal forms -----------------------------------------------------------------------------------------------------

#: Characters that NFKC leaves alone wherever they stand: ASCII, letters of Latin, Greek and Cyrillic that have no
#: compatibility form, and the unified ideographs.
PLAIN = r"^[\x00-\x7fÀ-ÖØ-öø-ıĴ-ľŁ-ňŊ-žΆΈ-ΊΌΎ-ΡΣ-ώЀ-ѿ一-鿿]*$"


def nfkc(df: DataFrame, col: str) -> DataFrame:
    """``df`` with ``col`` in normal form NFKC; only rows that may not be in it leave the JVM."""

    @F.pandas_udf("string")
    def normal(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda t: unicodedata.normalize("NFKC", t))

    plain = F.col(col).isNull() | F.col(col).rlike(PLAIN)
    return df.filter(plain).unionByName(df.filter(~plain).withColumn(col, normal(F.col(col))))


def like_pattern(text: Column) -> Column:
    """``text`` as the literal inside of a LIKE pattern with a backslash as escape."""
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def body(text: Column) -> Column:
    """A Markdown text without the front matter at its beginning."""
    return F.regexp_replace(text, r"^---[^\n]*\n(?s:.*?)(?<=\n)---[ \t]*(?:\n|$)", "")


def semantic_lines(diff: Column) -> Column:
    """What a unified diff adds and takes away, trimmed, in order; file heads, hunks and context are left out."""
    lines = F.transform(F.split(diff, "\n"), lambda x: F.regexp_replace(x, r"\r$", ""))
    changed = F.filter(lines, lambda x: x.rlike(r"^[+-]") & ~x.rlike(r"^(--- |\+\+\+ )"))
    return F.filter(F.transform(changed, lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.length(x)), r"^\s+|\s+$", "")), lambda x: x != "")


def split_top_level(text: Column, separator: str = ",") -> Column:
    """The trimmed pieces between separators outside brackets and quotes, empty ones left out."""

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([None if t is None else pieces(t, separator) for t in b], dtype=object)

    return split(text)


def pieces(text: str, separator: str) -> list[str]:
    depth, quote, skip, start, out = dict.fromkeys("([{", 0), "", False, 0, []
    opener = dict(zip(")]}", "([{", strict=True))
    for i, c in enumerate(text):
        if quote:
            skip, quote = (not skip and c == "\\"), ("" if c == quote and not skip else quote)
        elif c in "\"'`":
            quote = c
        elif c in depth:
            depth[c] += 1
        elif c in opener:
            depth[opener[c]] -= 1
        elif c == separator and not any(depth.values()):
            out.append(text[start:i])
            start = i + 1
    return [p.strip() for p in [*out, text[start:]] if p.strip()]


# --- paragraphs -------------------------------------------------------------------------------------------------------


def link_heavy(text: Column, share: float = 0.5) -> Column:
    """Whether links make up more than ``share`` of a paragraph."""
    t = F.trim(text)
    links = F.aggregate(F.regexp_extract_all(t, F.lit(r"\[[^\]]*\]\([^)]+\)"), F.lit(0)), F.lit(0), lambda a, x: a + F.length(x))
    return (F.length(t) > 0) & (links > F.length(t) * share)


def descriptive(text: Column, least: int = 20, share: float = 0.5) -> Column:
    """Prose of ``least`` characters or more: no heading, markup, image or table row, not mostly links."""
    t = F.trim(text)
    return (F.length(t) >= least) & ~t.rlike(r"^(#|<|!\[|\|)") & ~link_heavy(t, share)


def han_share(text: Column) -> Column:
    """CJK characters among them and ASCII letters; 0 of neither."""
    cjk = F.regexp_count(text, F.lit(r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{20000}-\x{2a6df}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]"))
    both = cjk + F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when(both == 0, 0.0).otherwise(cjk / both)


def excerpt(text: Column, name: Column, most: int = 200) -> Column:
    """Up to ``most`` characters around the first place of ``name``, with dots where they are cut; the beginning if it isn't there.

    A heading of two or more # on the line at which the window begins is kept whole.
    """
    half = most // 2
    at = F.position(name, text)
    first = F.greatest(F.lit(0), at - 1 - half)
    end = F.least(F.length(text), at - 1 + F.length(name) + half)
    before = F.substring(text, F.lit(1), first + 1)  # up to the window's first character
    line = F.concat(F.element_at(F.split(before, "\n"), -1), F.regexp_extract(F.substring(text, first + 2, F.length(text)), r"^[^\n]*", 0))
    rest = F.regexp_replace(F.substring(text, first + 1, end - first), r"^[^\n]*\n", "")
    heading = (first > 0) & before.contains("\n") & line.startswith("##") & F.substring(text, first + 1, F.length(text)).contains("\n")
    body = F.when(heading, F.concat(line, F.lit("\n"), rest)).otherwise(F.concat(F.when(first > 0, "...").otherwise(""), F.substring(text, first + 1, end - first)))
    found = F.left(F.concat(body, F.when(end < F.length(text), "...").otherwise("")), F.lit(most))
    start = F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most - 3)), F.lit("...")))
    return F.when(F.trim(text) == "", "").when(at > 0, found).otherwise(start)


def clean_html(text: Column) -> Column:
    """Text without script, style and comments, tags taken out, the five basic entities decoded, white space joined."""
    t = F.regexp_replace(text, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6])>", "\n"), r"<[^>]*>", "")
    for entity, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(c))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t\r\x0b\f]+", " "), r" ?\n[\n ]*", "\n"))


def natural_cut(text: Column, most: int) -> Column:
    """At most ``most`` characters, cut after the last sentence or line that ends in the second half of them, else at a space."""
    head = F.left(text, F.lit(most))
    sentence = F.regexp_extract(head, rf"^(?s:.{{{most // 2},}}[.!?。！？\n])", 0)
    word = F.regexp_extract(F.left(text, F.lit(most + 1)), r"^(?s:(.*\S))\s", 1)
    return F.when(F.length(text) <= most, text).when(sentence != "", F.rtrim(sentence)).when(word != "", word).otherwise(head)


def binary(content: Column) -> Column:
    """Whether the first 8,000 bytes hold a zero byte."""
    return F.hex(F.substring(content, 1, 8000)).rlike("^(..)*?00")


# --- paths and endpoints ----------------------------------------------------------------------------------------------


def url_path(*segments: Column) -> Column:
    """Segments joined by single slashes, / of none."""
    parts = F.transform(F.array(*segments), lambda s: F.regexp_replace(F.trim(s), r"^/+|/+$", ""))
    joined = F.array_join(F.filter(parts, lambda s: s != ""), "/")
    return F.regexp_replace(F.concat(F.lit("/"), joined), "/{2,}", "/")


def path_parameters(path: Column) -> Column:
    """Names of {name} and :name parameters, sorted, once each."""
    both = F.concat(F.regexp_extract_all(path, F.lit(r"\{([^}]+)\}"), F.lit(1)), F.regexp_extract_all(path, F.lit(r":([A-Za-z_]\w*)"), F.lit(1)))
    return F.array_sort(F.array_distinct(both))


def endpoint_tag(path: Column, file: Column) -> Column:
    """The first segment that names a subject, else the file's name, else default."""
    told = F.filter(F.split(path, "/"), lambda s: (s != "") & ~s.rlike(r"^[:{]") & ~F.lower(s).isin(*GENERIC) & ~s.rlike(r"^(?i:v\d+)$"))
    name = F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.get(told, F.lit(0)), F.nullif(name, F.lit("")), F.lit("default"))


def method_rank(method: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, METHODS)), F.upper(method))
    return F.when(at == 0, len(METHODS)).otherwise(at - 1).cast("int")


# --- time -------------------------------------------------------------------------------------------------------------


#: Fixed value: a point in time as it is written in JSON, in UTC.
ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?Z$"


def valid_iso(text: Column) -> Column:
    """Whether ``text`` is such a point in time and exists."""
    return F.coalesce(text.rlike(ISO) & F.try_to_timestamp(text).isNotNull(), F.lit(False))


def date_bucket(text: Column) -> Column:
    """The day of an ISO time, as text; null if it isn't one."""
    return F.when(valid_iso(text), F.left(text, F.lit(10)))


def latest(a: Column, b: Column) -> Column:
    """The later of two times, either of which may be missing."""
    return F.greatest(a, b)
