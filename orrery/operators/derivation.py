"""From code facts, documents and records to graph rows: flattening, roll-ups, audits, ranking and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.expressions import last_segment

# --- derivation of nodes and edges ------------------------------------------------------------------------------------


def relative_id(path: Column, root: str) -> tuple[Column, Column]:
    """(POSIX path below ``root``, whether it lies outside)."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    top = root.rstrip("/") + "/"
    inside = p.startswith(top) | ~p.startswith("/")
    return F.when(p.startswith(top), F.substring(p, F.lit(len(top) + 1), F.length(p))).otherwise(p), ~inside


def derive_nodes(skeletons: DataFrame) -> DataFrame:
    """(id, kind, label, file) of modules, their exported symbols and members; re-exports are left out, first ids win.

    ``skeletons``: file, exports array<struct<name, kind, reexport, members array<string>>>."""
    modules = skeletons.select(F.col("file").alias("id"), F.lit("module").alias("kind"), last_segment(F.replace("file", F.lit("/"), F.lit("."))).alias("label"), "file", F.lit(0).alias("o"))
    symbols = skeletons.select("file", F.posexplode("exports").alias("o", "e")).filter("NOT coalesce(e.reexport, false)")
    named = symbols.select(F.concat("file", F.lit("::"), "e.name").alias("id"), "e.kind", F.col("e.name").alias("label"), "file", "o", F.col("e.members").alias("m"))
    members = named.select("id", "file", "o", F.explode("m").alias("member")).select(F.concat("id", F.lit("."), "member").alias("id"), F.lit("member").alias("kind"), F.col("member").alias("label"), "file", "o")
    every = modules.unionByName(named.drop("m")).unionByName(members)
    return every.groupBy("id").agg(F.min_by(F.struct("kind", "label", "file"), F.struct("o", "kind")).alias("n")).select("id", "n.*")


def import_edges(skeletons: DataFrame) -> DataFrame:
    """(source, target, relation, import_type) of resolved imports of other files (imports array<struct<resolved, type>>)."""
    i = skeletons.select("file", F.explode("imports").alias("i")).filter("i.resolved IS NOT NULL AND i.resolved <> file")
    return i.select(F.col("file").alias("source"), F.col("i.resolved").alias("target"), F.lit("depends-on").alias("relation"), F.col("i.type").alias("import_type")).distinct()


def contains_edges(nodes: DataFrame) -> DataFrame:
    """(source, target) from modules to symbols and from symbols to members, by their ids."""
    parent = F.when(F.col("id").rlike(r"::.*\."), F.regexp_replace("id", r"\.[^.]*$", "")).otherwise(F.regexp_replace("id", "::.*$", ""))
    return nodes.filter(F.col("id").contains("::")).select(parent.alias("source"), F.col("id").alias("target")).distinct()


def cross_language(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(language, target) of edges whose target (file, language) is of another language."""
    a, b = files.select(F.col("file").alias("source"), F.col("language").alias("language")), files.select(F.col("file").alias("target"), F.col("language").alias("other"))
    return edges.join(a, "source").join(b, "target").filter("language <> other").select("language", "target").distinct()


def cross_references(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, counterpart, outgoing, incoming, direction) between groups (id, grp)."""
    a, b = groups.select(F.col("id").alias("source"), F.col("grp").alias("a")), groups.select(F.col("id").alias("target"), F.col("grp").alias("b"))
    pairs = edges.join(a, "source").join(b, "target").filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    both = pairs.select(F.col("a").alias("grp"), F.col("b").alias("counterpart"), F.col("n").alias("o"), F.lit(0).cast("long").alias("i")).unionByName(pairs.select(F.col("b").alias("grp"), F.col("a").alias("counterpart"), F.lit(0).cast("long").alias("o"), F.col("n").alias("i")))
    sums = both.groupBy("grp", "counterpart").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))
    return sums.withColumn("direction", F.when(F.col("incoming") == 0, "out").when(F.col("outgoing") == 0, "in").otherwise("both"))


def module_groups(files: DataFrame, depth: int = 1) -> DataFrame:
    """(path, grp): the first ``depth`` folders below the base that over 80 % of files share (src/, else lib/)."""
    n = files.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("path").startswith("src/"), 1)).alias("s"), F.count(F.when(F.col("path").startswith("lib/"), 1)).alias("l"))
    base = n.select(F.when(F.col("s") > 0.8 * F.col("n"), "src/").when(F.col("l") > 0.8 * F.col("n"), "lib/").otherwise("").alias("base"))
    based = files.select("path").join(F.broadcast(base))  # one row
    rest = F.when(F.col("path").startswith(F.col("base")), F.substring("path", F.length("base") + 1, F.length("path"))).otherwise(F.col("path"))
    parts = F.split(rest, "/")
    return based.select("path", F.when(F.size(parts) <= 1, "root").otherwise(F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(depth), F.size(parts) - 1)), "/")).alias("grp"))


def combined_hash(files: DataFrame) -> DataFrame:
    """(grp, hash): a file's own hash, or the hash of several ones' hashes in the order of their paths."""
    parts = F.array_sort(F.collect_list(F.struct("path", "hash")))
    joined = files.groupBy("grp").agg(parts.alias("p"))
    return joined.select("grp", F.when(F.size("p") == 1, F.col("p")[0]["hash"]).otherwise(F.sha2(F.array_join(F.transform("p", lambda x: x["hash"]), ""), 256)).alias("hash"))


# --- documents --------------------------------------------------------------------------------------------------------


def ingest(existing: DataFrame, incoming: DataFrame, least: int = 20) -> DataFrame:
    """Chunks (doc_id, chunk_id, text) after an import: documents imported again are replaced, chunks under ``least``
    characters and texts that are there already (or twice in the batch) don't come in."""
    kept = existing.join(incoming.select("doc_id").distinct(), "doc_id", "left_anti").select(incoming.columns)
    first = incoming.filter(F.length("text") >= least).groupBy("text").agg(F.min(F.struct("chunk_id", "doc_id")).alias("c")).select("c.doc_id", "c.chunk_id", "text")
    return kept.unionByName(first.join(kept.select("text"), "text", "left_anti").select(incoming.columns))


def coverage_audit(units: DataFrame, specs: DataFrame) -> DataFrame:
    """(unit, status, issues) of units (unit, files) against specs (spec, files, links, confidence)."""
    has = units.select("unit", F.explode("files").alias("file")).join(specs.select("spec", "links", "confidence", F.explode("files").alias("file")), "file", "left")
    by = has.groupBy("unit").agg(F.countDistinct("spec").alias("specs"), F.max("links").alias("links"), F.max("confidence").alias("confidence"))
    issue = lambda c, name: F.when(c, name)
    issues = F.array_sort(F.array_compact(F.array(issue(F.col("specs") == 0, "missing-doc"), issue((F.col("specs") > 0) & (F.col("links") == 0), "missing-links"), issue((F.col("specs") > 0) & (F.col("confidence") < 0.5), "low-confidence"))))
    return by.select("unit", issues.alias("issues")).withColumn("status", F.when(F.array_contains("issues", "missing-doc"), "missing-doc").when(F.size("issues") > 0, "attention").otherwise("documented"))


def level_coverage(audit: DataFrame) -> DataFrame:
    """Per level counts and the share documented, in percent with one place; 100 of nothing."""
    n = lambda x: F.count(F.when(F.col("status") == x, 1))
    by = audit.groupBy("level").agg(F.count(F.lit(1)).alias("total"), n("documented").alias("documented"), n("missing-doc").alias("missing"), n("attention").alias("attention"))
    return by.withColumn("percent", F.when(F.col("total") == 0, 100.0).otherwise(F.round(F.col("documented") * 100 / F.col("total"), 1)))


def references(links: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, refers_to, referred_by) of documents with links (source, target) among them."""
    known = docs.select("doc_id")
    e = links.join(known.withColumnRenamed("doc_id", "source"), "source", "left_semi").join(known.withColumnRenamed("doc_id", "target"), "target", "left_semi").distinct()
    out = e.groupBy(F.col("source").alias("doc_id")).agg(F.array_sort(F.collect_set("target")).alias("refers_to"))
    back = e.groupBy(F.col("target").alias("doc_id")).agg(F.array_sort(F.collect_set("source")).alias("referred_by"))
    return known.join(out, "doc_id", "left").join(back, "doc_id", "left").select("doc_id", F.coalesce("refers_to", F.array()).alias("refers_to"), F.coalesce("referred_by", F.array()).alias("referred_by"))


#: Comment tags with their severity, and what marks an open question.
DEBT = {"TODO": "medium", "FIXME": "high", "HACK": "high", "XXX": "high", "NOTE": "low"}
OPEN = r"(?i)\b(tbd|open question|to be decided|unresolved|trade-?off)\b"


def debt_comments(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line, tag, owner, severity, note) of tagged comments."""
    tag = r"\b(TODO|FIXME|HACK|XXX|NOTE)\b(?:\(([^)]*)\))?:?\s*(.*)$"
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\r?\n")).alias("line", "l")).filter(F.col("l").rlike(tag))
    name = F.regexp_extract("l", tag, 1)
    severity = F.element_at(F.create_map(*[F.lit(v) for kv in DEBT.items() for v in kv]), name)
    return rows.select("id", "line", name.alias("tag"), F.nullif(F.regexp_extract("l", tag, 2), F.lit("")).alias("owner"), severity.alias("severity"), F.regexp_extract("l", tag, 3).alias("note"))


def open_questions(paragraphs: DataFrame, text_col: str = "text") -> DataFrame:
    """``verdict`` of paragraphs: confirmed by a keyword, candidate if they end in a question mark; 400-character snippets."""
    verdict = F.when(F.col(text_col).rlike(OPEN), "confirmed").when(F.rtrim(text_col).rlike("[?？]$"), "candidate")
    return paragraphs.withColumn("verdict", verdict).filter("verdict IS NOT NULL").withColumn("snippet", F.left(text_col, F.lit(400)))


def sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line, path, text) of Markdown paragraph lines with their heading path; fenced lines are as blank ones.

    One document's lines are one window, so a document is the largest unit of work."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\r?\n")).alias("line", "text"))
    w = Window.partitionBy("id").orderBy("line")
    fence = F.col("text").rlike(r"^\s*(```|~~~)")
    lines = lines.withColumn("open", F.sum(F.when(fence, 1).otherwise(0)).over(w) % 2 == 1)
    level = F.when(~F.col("open") & F.col("text").rlike("^#{1,6} "), F.length(F.regexp_extract("text", "^(#{1,6}) ", 1)))
    lines = lines.withColumn("level", level)
    path = []
    for k in range(1, 7):  # the last heading of level k, unless a higher one came after it
        lines = lines.withColumn(f"h{k}", F.last(F.when(F.col("level") == k, F.struct("line", F.regexp_extract("text", "^#{1,6} +(.*?) *$", 1).alias("t"))), ignorenulls=True).over(w))
        lines = lines.withColumn(f"c{k}", F.last(F.when(F.col("level") < k, F.col("line")), ignorenulls=True).over(w))
        path.append(F.when(F.col(f"h{k}.line") > F.coalesce(F.col(f"c{k}"), F.lit(-1)), F.col(f"h{k}.t")))
    kept = lines.filter(F.col("level").isNull() & ~fence & ~F.col("open") & (F.trim("text") != ""))
    return kept.select("id", "line", F.array_compact(F.array(*path)).alias("path"), "text")


def evidence_block(hits: DataFrame, limit: int = 4000) -> DataFrame:
    """(query_id, block): hits (rank, text, source) wrapped with their source, sentinels defused, cut at ``limit``."""
    safe = F.replace(F.replace("text", F.lit("<<<"), F.lit("< <<")), F.lit(">>>"), F.lit("> >>"))
    wrapped = hits.select("query_id", "rank", F.concat(F.lit("<<<"), "source", F.lit("\n"), safe, F.lit("\n>>>")).alias("t"))
    # a hit takes 9 characters or more, its line feed included, and none if its text is null: only the first can fit
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("t").isNull(), "rank", "t"))
    wrapped = wrapped.withColumn("place", place).filter(F.col("place") <= limit // 9 + 1)
    parts = wrapped.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "t"))).alias("p"))
    return parts.select("query_id", F.left(F.array_join(F.transform("p", lambda x: x["t"]), "\n"), F.lit(limit)).alias("block"))


def resolve_version(candidates: DataFrame) -> DataFrame:
    """(project, version, verdict) from (project, origin, version), origin explicit, lockfile or range."""
    of = lambda o: F.col("origin") == o
    by = candidates.groupBy("project").agg(F.max(F.when(of("explicit"), F.col("version"))).alias("e"), F.countDistinct(F.when(of("lockfile"), F.col("version"))).alias("n"), F.max(F.when(of("lockfile"), F.col("version"))).alias("l"), F.count(F.when(of("range"), 1)).alias("r"))
    verdict = F.when(F.col("e").isNotNull(), "explicit").when(F.col("n") > 1, "ambiguous").when(F.col("n") == 1, "lockfile").when(F.col("r") > 0, "range-only").otherwise("none")
    return by.select("project", F.when(F.col("e").isNotNull(), F.col("e")).when(F.col("n") == 1, F.col("l")).alias("version"), verdict.alias("verdict"))


# --- selection and scoring --------------------------------------------------------------------------------------------


def seeds(nodes: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, weight) of nodes whose label (1.0) or path (0.5) holds question terms (term)."""
    t = terms.select(F.lower("term").alias("term")).distinct()
    # a question has a handful of terms: the terms are the small side, and its size is the question's length
    hit = nodes.join(F.broadcast(t), F.lower("label").contains(F.col("term")) | F.lower("id").contains(F.col("term")))
    weight = F.when(F.lower("label").contains(F.col("term")), 1.0).otherwise(0.0) + F.when(F.lower("id").contains(F.col("term")), 0.5).otherwise(0.0)
    return hit.groupBy("id").agg(F.sum(weight).alias("weight"))


def pattern_hints(signals: DataFrame, least: float = 0.3) -> DataFrame:
    """(subject, pattern, score, rank, gap) of (subject, pattern, weight, matched, penalty): matched share of positive
    weights less penalties, ranked, with the lead over the next."""
    by = signals.groupBy("subject", "pattern").agg((F.sum(F.when(F.col("matched"), F.col("weight")).otherwise(0.0)) / F.sum("weight") - F.sum("penalty")).alias("score")).filter(F.col("score") >= least)
    w = Window.partitionBy("subject").orderBy(F.desc("score"), "pattern")
    return by.withColumn("rank", F.row_number().over(w)).withColumn("gap", F.col("score") - F.lead("score").over(w))


def directory_class(signals: DataFrame, least: float = 0.6) -> DataFrame:
    """(directory, class): the category of the greatest weight, source where none reaches ``least``."""
    best = signals.groupBy("directory").agg(F.max(F.struct("weight", "category")).alias("b"))
    return best.select("directory", F.when(F.col("b.weight") < least, "source").otherwise(F.col("b.category")).alias("class"))


def within_budget(items: DataFrame, budget: int) -> DataFrame:
    """The items (grp, priority, id, cost) of each group that fit, in order of priority and id, until the budget is spent."""
    run = F.sum("cost").over(Window.partitionBy("grp").orderBy("priority", "id").rowsBetween(Window.unboundedPreceding, 0))
    return items.withColumn("spent", run).filter(F.col("spent") <= budget)


def merge_known(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Current records win over stored ones (path, hash, kind) of the same path; stored ones need a hash and a canonical kind."""
    kind = F.when(F.col("kind").isin("canonical", "draft", "archive"), F.col("kind")).otherwise("canonical")
    old = stored.withColumn("kind", kind).filter("hash IS NOT NULL AND kind = 'canonical'").join(current.select("path"), "path", "left_anti")
    return current.withColumn("kind", kind).select("path", "hash", "kind").unionByName(old.select("path", "hash", "kind"))


def build_order(nodes: list[str], edges: list[tuple[str, str]]) -> list[str]:
    """Dependencies first, the smallest ready name each time, members of cycles last in input order. For the module
    graph of one build, which is a plan on the driver and not data."""
    import heapq

    needs = {n: {b for a, b in edges if a == n and b != n and b in nodes} for n in nodes}
    ready = [n for n in nodes if not needs[n]]
    heapq.heapify(ready)
    out: list[str] = []
    while ready:
        n = heapq.heappop(ready)
        out.append(n)
        for m in nodes:
            if n in needs[m]:
                needs[m].discard(n)
                if not needs[m]:
                    heapq.heappush(ready, m)
    return out + [n for n in nodes if n not in out]


def valid_hyperedges(hyperedges: DataFrame, code_nodes: DataFrame) -> DataFrame:
    """Hyperedges (id, label, nodes, rationale, confidence) within their bounds and with a code node (id)."""
    fine = (F.size("nodes") >= 3) & F.length("label").between(1, 8) & F.length("rationale").between(1, 200) & F.col("confidence").isin("EXTRACTED", "INFERRED", "AMBIGUOUS")
    some = hyperedges.filter(fine)
    grounded = some.select("id", F.explode("nodes").alias("n")).join(code_nodes.select(F.col("id").alias("n")), "n", "left_semi").select("id").distinct()
    return some.join(grounded, "id", "left_semi")
