"""Texts cut into pieces that keep their place: sections with line ranges, and long files at the borders of functions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.durable import cut

#: Tokens of a piece of a section, characters of a token, and lines from which a file is long.
TOKENS, CHARS, LONG = 512, 4, 5000
BORDER = re.compile(r"^(export |public |private |protected |static |async |abstract )*(function|class|def|func|fn|interface|struct|enum|impl)\b")
SYMBOL = re.compile(r"^\s*(?:(?:export|public|private|protected|static|async|abstract|default) )*(?:function|class|def|func|fn|interface|struct|enum) +([A-Za-z_$][\w$]*)")


def section_pieces(text: str, tokens: int) -> Iterator[tuple[int, int, str, str]]:
    """(first line, last line, heading path, text), lines from 1: sections of H2 and H3 headings, the whole text if there are
    none. A piece is a run of lines that fits, cut at blank lines where it can be, and begins with its heading; a line
    that doesn't fit by itself is a piece by itself, cut by characters."""
    lines = text.split("\n")
    heads = [i for i, line in enumerate(lines) if re.match(r"###?\s", line)]
    starts = heads or [0]
    above = ""
    for k, start in enumerate(starts):
        end = starts[k + 1] if k + 1 < len(starts) else len(lines)
        head, body = (lines[start].strip(), start + 1) if heads else ("", start)
        if heads and not head.startswith("###"):
            above = head
        path = head if head == above or not above else f"{above} > {head}"
        room = tokens * CHARS - (len(head) + 1 if head else 0)
        at = body
        while at < end:
            stop, size, blank = at, 0, None
            while stop < end and size + len(lines[stop]) + (stop > at) <= room:
                size += len(lines[stop]) + (stop > at)
                blank = stop if not lines[stop].strip() else blank
                stop += 1
            if stop < end and blank is not None and blank > at:
                stop = blank + 1
            if stop == at:  # one line that is too long
                for i in range(0, len(lines[at]), room):
                    yield at + 1, at + 1, path, (head + "\n" if head else "") + lines[at][i : i + room]
                at += 1
                continue
            piece = "\n".join(lines[at:stop]).strip("\n")
            if piece.strip():
                yield (start + 1 if at == body else at + 1), stop, path, (head + "\n" if head else "") + piece
            at = stop


def section_chunks(files: DataFrame, tokens: int = TOKENS) -> DataFrame:
    """(path, seq, first, last, heading, text) of files (path, text); nulls and blank texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, i, *piece) for p, t in zip(b["path"], b["text"], strict=True) if t for i, piece in enumerate(section_pieces(t, tokens))]
            yield pd.DataFrame(rows, columns=["path", "seq", "first", "last", "heading", "text"])

    return files.select("path", "text").mapInPandas(run, "path string, seq int, first int, last int, heading string, text string")


def long_pieces(text: str, most: int) -> list[tuple[int, int, str, list[str]]]:
    """(first line, last line, text, symbols): files of up to ``most`` lines whole, longer ones before the last border of a
    function in the second half of each piece, at the line where there is none."""
    lines, out, at = text.split("\n"), [], 0
    while at < len(lines):
        end = min(at + most, len(lines))
        if end < len(lines):
            end = next((i for i in range(end, at + most // 2, -1) if BORDER.match(lines[i])), end)
        part = lines[at:end]
        out.append((at + 1, end, "\n".join(part), list(dict.fromkeys(m[1] for x in part if (m := SYMBOL.match(x))))))
        at = end
    return out


def file_chunks(files: DataFrame, most: int = LONG) -> DataFrame:
    """(path, seq, first, last, text, symbols) of files (path, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, i, *piece) for p, t in zip(b["path"], b["text"], strict=True) if t is not None for i, piece in enumerate(long_pieces(t, most))]
            yield pd.DataFrame(rows, columns=["path", "seq", "first", "last", "text", "symbols"])

    return files.select("path", "text").mapInPandas(run, "path string, seq int, first int, last int, text string, symbols array<string>")


# --- lines ------------------------------------------------------------------------------------------------------------

#: Characters of a pattern, lines of context, matches by default and at most, and what makes a pattern risky.
PATTERN, CONTEXT, MATCHES, MOST = 200, 20, 50, 1000
RISKY = (r"\([^)]*[+*{][^)]*\).*\)\s*([+*]|\{\d+,?\d*\})", r"\([^)]*[+*{][^)]*\)\s*([+*]|\{\d+,?\d*\})", r"\([^)]*\|[^)]*\)\s*[+*]")


def find_lines(files: DataFrame, pattern: str, regex: bool = False, context: int = 0, most: int = MATCHES) -> DataFrame:
    """(path, line, text, before, after, total) of the first ``most`` lines of each file (path, text) with the pattern, lines
    from 1, with up to ``context`` lines around them and the number of all matches; bounds are kept, risky patterns refused."""
    if not pattern or len(pattern) > PATTERN:
        raise ValueError(f"a pattern has 1 to {PATTERN} characters")
    if regex and any(re.search(r, pattern) for r in RISKY):
        raise ValueError("the pattern repeats a group that repeats")
    context, most = max(0, min(context, CONTEXT)), max(1, min(most, MOST))
    lines = F.split("text", "\r?\n")
    hit = (lambda x: x.rlike(pattern)) if regex else (lambda x: x.contains(pattern))
    rows = files.select("path", lines.alias("l")).withColumn("at", F.filter(F.transform("l", lambda x, i: F.when(hit(x), i)), lambda i: i.isNotNull()))
    each = rows.filter("size(at) > 0").select("path", "l", F.size("at").alias("total"), F.explode(F.slice("at", 1, most)).alias("i"))
    first = F.greatest(F.col("i") - context, F.lit(0))
    return each.select(
        "path", (F.col("i") + 1).alias("line"), F.get("l", "i").alias("text"), F.slice("l", first + 1, F.col("i") - first).alias("before"), F.slice("l", F.col("i") + 2, F.lit(context)).alias("after"), "total"
    )


# --- files and their callers ------------------------------------------------------------------------------------------


def expand_callers(edges: DataFrame, owners: DataFrame, changed: DataFrame, hops: int = 2) -> DataFrame:
    """(file, hop) of the changed files (file), at hop 0, and of those whose nodes point at theirs, by any relation, up to ``hops``
    away; ends as soon as nothing new is found. ``owners``: id, file."""
    a, b = owners.select(F.col("id").alias("source"), F.col("file").alias("file")), owners.select(F.col("id").alias("target"), F.col("file").alias("_t"))
    links = cut(edges.join(a, "source").join(b, "target").filter("file <> _t").select("file", "_t").distinct())
    found = frontier = cut(changed.select("file", F.lit(0).alias("hop")).distinct())
    for hop in range(1, hops + 1):
        step = cut(links.join(frontier.select(F.col("file").alias("_t")), "_t").select("file").distinct().join(found, "file", "left_anti").withColumn("hop", F.lit(hop)))
        if step.isEmpty():
            break
        found, frontier = found.unionByName(step), step
    return found


def propagate(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(id, impacted_by) of all that depends on the changed nodes (id), directly or not, with the changed or affected nodes
    that each depends on; changed ones themselves are left out."""
    from orrery.operators.graph import bfs

    e = cut(edges.filter("source <> target").select("source", "target").distinct())
    reached = bfs(e.withColumn("score", F.lit(1.0)), changed, 1_000_000, "upstream").select("id")  # ends when nothing new is reached
    every = reached.unionByName(changed.select("id")).distinct()
    hit = e.join(reached.withColumnRenamed("id", "source"), "source", "left_semi").join(every.withColumnRenamed("id", "target"), "target", "left_semi")
    return hit.groupBy(F.col("source").alias("id")).agg(F.array_sort(F.collect_set("target")).alias("impacted_by"))


def context(nodes: DataFrame, edges: DataFrame, ids: DataFrame, most: int = 50) -> DataFrame:
    """(id, label, callers, callees, imports, container, n_callers): what stands around each of ``ids`` (id), of callers, callees
    and imports the first ``most`` by score and id."""
    from orrery.operators.graph import top_in_group

    n = ids.join(nodes.select("id", "label"), "id")

    def around(relation: str, here: str, there: str, name: str) -> DataFrame:
        rows = edges.filter(F.col("relation") == relation).select(F.col(here).alias("id"), F.col(there).alias("o"), "score").join(ids, "id", "left_semi")
        return top_in_group(rows, "id", [F.desc("score"), F.col("o")], most).groupBy("id").agg(F.array_sort(F.collect_list("o")).alias(name))

    none = F.array().cast("array<string>")
    out = n.join(around("calls", "target", "source", "callers"), "id", "left").join(around("calls", "source", "target", "callees"), "id", "left").join(around("depends-on", "source", "target", "imports"), "id", "left")
    inside = edges.filter("relation = 'contains'").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").groupBy(F.col("target").alias("id")).agg(F.min("source").alias("container"))
    many = edges.filter("relation = 'calls'").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("n_callers"))
    return out.join(inside, "id", "left").join(many, "id", "left").select("id", "label", *[F.coalesce(c, none).alias(c) for c in ("callers", "callees", "imports")], "container", F.coalesce("n_callers", F.lit(0).cast("long")).alias("n_callers"))


def matching_hyperedges(hyperedges: DataFrame, label: str | None = None, node: str | None = None, limit: int = 50) -> DataFrame:
    """The first ``limit`` hyperedges (id, label, nodes), by id, with ``label`` in theirs in any case, and with the node."""
    rows = hyperedges.filter(F.lower("label").contains(label.lower())) if label else hyperedges
    return (rows.filter(F.array_contains("nodes", node)) if node else rows).orderBy("id").limit(limit)
