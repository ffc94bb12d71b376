"""Knowledge-base tools around the search: safe queries, look-ups, arbitration of API entities, evidence, records and builds."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions.durable import written
from orrery.functions.texts import nfkc
from orrery.operators.retrieval import check_parameters, kb_tokens
from orrery.operators.substrings import containing, holding_han

# --- queries ----------------------------------------------------------------------------------------------------------


def distinct_tokens(text: Column) -> Column:
    """Tokens once each, in order, upper and lower case apart."""
    return F.array_distinct(kb_tokens(text))


def sanitised(text: Column, mode: str = "OR") -> Column:
    """(code, tokens, match) of a question: every token is quoted, so that none is an operator; without tokens INVALID_QUERY."""
    tokens = distinct_tokens(text)
    quoted = F.transform(tokens, lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"')))
    fine = F.size(tokens) > 0
    return F.struct(F.when(fine, "ok").otherwise("INVALID_QUERY").alias("code"), tokens.alias("tokens"), F.when(fine, F.array_join(quoted, f" {mode} ")).alias("match"))


def index_text(text: Column) -> Column:
    """Tokens joined by spaces, as they are indexed."""
    return F.array_join(kb_tokens(text), " ")


def equivalence(text: Column) -> Column:
    """Lower-cased tokens once each, in order: questions with equal ones count as the same."""
    return F.array_join(F.array_distinct(F.transform(kb_tokens(text), lambda t: F.lower(t))), " ")


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


#: What is masked in questions before they are recorded, in this order, under these names.
REDACTIONS = (
    ("URL_WITH_CRED", r"(?i)(?:[a-z][a-z0-9+.-]*://[^\s/@]+:[^\s/@]+@\S*)|(?:[a-z][a-z0-9+.-]*://\S*[?&](?:token|key|secret|password|passwd|api_key|apikey|access_token)=\S*)"),
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("TOKEN", r"(?<![A-Za-z0-9_])(?:(?:sk|pk|rk)-[A-Za-z0-9_-]{8,}|(?:github_pat|ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9_]{8,}|(?i:bearer)\s+[A-Za-z0-9._+/=-]+)"),
    ("HOME", r"(?i:/users/|/home/)[^\s/\\]+|[A-Za-z]:\\(?i:users)\\[^\s\\]+"),
    ("HIGH_ENTROPY", r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/=]{20,}(?![A-Za-z0-9+/=])"),
    ("DIGITS", r"(?<!\d)\d{8,}(?!\d)"),
)


#: By rule: what a text, in small letters, must hold for the rule to find anything (None: any text), and the same rule for
#: find-and-replace, which looks at a run of characters once, from its beginning or from where the last find ended; its first
#: group is not masked.
HOLDING = {
    "URL_WITH_CRED": ("://",), "EMAIL": ("@",), "TOKEN": ("sk-", "pk-", "rk-", "github_pat_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "bearer"),
    "HOME": ("/users/", "/home/", ":\\users\\"), "HIGH_ENTROPY": None, "DIGITS": None,
}
QUICKER = {
    "URL_WITH_CRED": r"(?i)(?:(?<![a-z0-9+.-])|\G)([0-9+.-]*+)(?:" + REDACTIONS[0][1].removeprefix("(?i)").replace("[a-z][a-z0-9+.-]*:", "[a-z][a-z0-9+.-]*+:") + ")",
    "EMAIL": r"((?:(?<![A-Za-z0-9._%+-])|\G))" + REDACTIONS[1][1].replace("+@", "++@"),
}


def redacted(rows: DataFrame, col: str = "text") -> DataFrame:
    """``rows`` with ``col`` masked, and ``tags``: each rule masks what it finds with its name, one after the other; its tag says
    that it changed something, as no rule finds a mask.

    The rules are written for text in NFKC (``redact_queries``). Each text is a column of its own, so that it is made once.
    """
    out, tags = rows.withColumn("_t0", F.col(col)), []
    for i, (tag, pattern) in enumerate(REDACTIONS):
        now, masked = F.col(f"_t{i}"), F.regexp_replace(f"_t{i}", QUICKER.get(tag, pattern), f"$1<{tag}>" if tag in QUICKER else f"<{tag}>")
        if HOLDING[tag]:
            low = F.lower(now)
            masked = F.when(reduce(or_, (low.contains(x) for x in HOLDING[tag])), masked).otherwise(now)
        out = out.withColumn(f"_t{i + 1}", masked)
        tags.append(F.when(now != F.col(f"_t{i + 1}"), tag))
    out = out.withColumn(col, F.col(f"_t{len(REDACTIONS)}")).withColumn("tags", F.array_compact(F.array(*tags)))
    return out.drop(*[f"_t{i}" for i in range(len(REDACTIONS) + 1)])


def redact_queries(queries: DataFrame, col: str = "text") -> DataFrame:
    """``queries`` in NFKC and masked, with ``tags``; null as empty."""
    return redacted(nfkc(queries.withColumn(col, F.coalesce(F.col(col), F.lit(""))), col), col)


def no_hit_records(queries: DataFrame) -> DataFrame:
    """Records of questions (tool, text, time, kb) without a hit: masked terms and hashes, never the question; by ``date``."""
    q = redact_queries(queries.filter(F.col("tool").isin("kb_search", "kb_api_lookup") & F.col("text").isNotNull()), "text")
    return q.select(
        F.lit(1).alias("schema_version"), "time", F.date_format("time", "yyyyMMdd").alias("date"), "tool", distinct_tokens(F.col("text")).alias("terms"),
        short_hash(equivalence(F.col("text"))).alias("query_hash"), "tags", F.lit(0).alias("result_count"), short_hash(F.col("kb")).alias("kb_hash"),
    )


def append_records(records: DataFrame, path: str) -> None:
    """Append JSON lines below ``path``, a folder for each date; earlier ones stay as they are."""
    records.write.mode("append").partitionBy("date").json(path)


# --- search -----------------------------------------------------------------------------------------------------------


def with_metadata(scored: DataFrame, meta: DataFrame, version: str | None = None, top: int = 5) -> DataFrame:
    """Scored chunks (query_id, chunk_id, score) with their metadata, of one version if given, the best ``top`` of each query.

    Scores are made over the whole base before the version is asked for, so statistics don't depend on it.
    """
    rows = meta.filter(F.col("sdk_version") == version) if version is not None else meta
    best = Window.partitionBy("query_id").orderBy("score", "chunk_id")
    return scored.join(rows, "chunk_id").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)


def han_fallback(hits: DataFrame, chunks: DataFrame, queries: DataFrame, top: int = 5, floor: int = 3, postings: DataFrame | None = None) -> DataFrame:
    """``hits`` (query_id, chunk_id, score) of ``queries`` (query_id, text) with what a substring search adds for questions
    of one or two Han characters and fewer than ``floor`` hits: score 1, after the others, none twice. The search reads
    ``postings`` of characters and pairs (``han_postings``)."""
    n = F.regexp_count("text", F.lit(r"\p{IsHan}"))
    few = queries.join(hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").filter((n >= 1) & (n <= 2) & (F.coalesce("n", F.lit(0)) < floor))
    more = holding_han(chunks, few.select("query_id", F.trim("text").alias("wanted")), postings).withColumn("score", F.lit(1.0))
    both = hits.select("query_id", "chunk_id", "score").unionByName(more.join(hits, ["query_id", "chunk_id"], "left_anti"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "chunk_id"))).filter(F.col("rank") <= top)


def of_source(rows: DataFrame, source: str = "all") -> DataFrame:
    """Rows (source_kind) of vendor, project or all."""
    if source not in ("vendor", "project", "all"):
        raise ValueError(f"no such source: {source}")
    return rows if source == "all" else rows.filter(F.col("source_kind") == source)


def both_sources(vendor: DataFrame, project: DataFrame) -> DataFrame:
    """The rows of two bases, each with its ``source_kind``."""
    return vendor.withColumn("source_kind", F.lit("vendor")).unionByName(project.withColumn("source_kind", F.lit("project")), allowMissingColumns=True)


# --- look-ups ---------------------------------------------------------------------------------------------------------


def document_edges(docs: DataFrame) -> DataFrame:
    """(source, target, relation) of ``docs`` (doc_id, links) that refer to each other, once each."""
    known = docs.select(F.col("doc_id").alias("target")).distinct()
    return docs.select(F.col("doc_id").alias("source"), F.explode(F.array_distinct("links")).alias("target")).distinct().join(known, "target", "left_semi").select("source", "target", F.lit("references").alias("relation"))


def lookup_documents(docs: DataFrame, refs: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, code, doc_id, title, source_kind, refers_to, referred_by) for ``asked`` (query_id, id, keyword).

    An id is looked up exactly and goes before a keyword, which is part of a title in any case; a question with neither
    has code INVALID_LOOKUP_ARG, one without a document gives no row. References are the links (source, target) of
    the base that the document is of (``docs``: doc_id, title, source_kind; ``refs``: source, target, source_kind).
    """
    some = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    bad = asked.filter(~some("id") & ~some("keyword")).select("query_id", F.lit("INVALID_LOOKUP_ARG").alias("code"))
    exact = asked.filter(some("id")).select("query_id", F.col("id").alias("doc_id")).join(docs, "doc_id")
    keyed = asked.filter(~some("id") & some("keyword")).select("query_id", F.lower("keyword").alias("_k"))
    titled = containing(docs.select("doc_id", "title", "source_kind", F.lower("title").alias("_t")), "_t", keyed, "_k")
    found = exact.select("query_id", "doc_id", "title", "source_kind").unionByName(titled.select("query_id", "doc_id", "title", "source_kind"))
    out = refs.groupBy(F.col("source").alias("doc_id"), "source_kind").agg(F.array_sort(F.collect_set("target")).alias("refers_to"))
    back = refs.groupBy(F.col("target").alias("doc_id"), "source_kind").agg(F.array_sort(F.collect_set("source")).alias("referred_by"))
    none = F.array().cast("array<string>")
    rows = found.join(out, ["doc_id", "source_kind"], "left").join(back, ["doc_id", "source_kind"], "left")
    rows = rows.select("query_id", F.lit("ok").alias("code"), "doc_id", "title", "source_kind", F.coalesce("refers_to", none).alias("refers_to"), F.coalesce("referred_by", none).alias("referred_by"))
    return rows.unionByName(bad, allowMissingColumns=True)


def matched_entities(queries: DataFrame, entities: DataFrame, top: int = 10) -> DataFrame:
    """``entities`` (entity_id, name, qualified, kind, container, ...) that ``queries`` (query_id, api, kind, container) may
    mean, with match (exact, fuzzy), distance and rank.

    Kind and container of a question, if given, must be the entity's. Distance: 0 if the question is the name, the
    qualified name or its last part; 1 if it is part of one of them or holds a name of four characters or more; else 2
    less the share of its words that the entity has. No common word: no match.
    """
    low = lambda c: F.lower(F.trim(c))
    words = lambda c: F.transform(kb_tokens(c), lambda t: F.lower(t))
    q = queries.filter(low("api") != "").select("query_id", low("api").alias("_q"), F.array_distinct(words(F.col("api"))).alias("_qw"), F.col("kind").alias("_kind"), low("container").alias("_in"))
    e = entities.withColumn("_n", low("name")).withColumn("_f", low("qualified")).withColumn("_l", F.element_at(F.split(low("qualified"), r"\."), -1)).withColumn("_ew", F.array_distinct(F.concat(words(F.col("name")), words(F.col("qualified")))))
    # entities alike in all that a question looks at are equally near to it: of each class its first ``top`` are enough
    same = ["name", "qualified", "kind", "container"]
    first = F.row_number().over(Window.partitionBy(*same).orderBy("entity_id", "source_kind"))
    members = F.collect_list(F.struct(*[c for c in entities.columns if c not in same])).alias("_members")
    e = e.withColumn("_r", first).filter(F.col("_r") <= top).groupBy(*same, "_n", "_f", "_l", "_ew").agg(members)
    # what is read back looks small by its file size: hints keep it, and what it is exploded to, from being broadcast
    e = written(e.withColumn("_e", F.monotonically_increasing_id()), "entities").hint("merge")
    # candidates by key: a name that holds the question, a question that holds a name, and a common word
    names = e.select("_e", F.explode(F.array_distinct(F.array("_n", "_f"))).alias("_text"))
    asked = q.select("query_id", "_q")
    held = containing(names, "_text", asked, "_q").select("_e", "query_id")
    holds = containing(asked, "_q", e.filter(F.length("_n") >= 4).select("_e", "_n"), "_n").select("_e", "query_id")
    shared = e.select("_e", F.explode("_ew").alias("_w")).hint("merge").join(q.select("query_id", F.explode("_qw").alias("_w")), "_w").select("_e", "query_id")
    fits = (F.col("_kind").isNull() | (F.col("_kind") == F.col("kind"))) & (F.col("_in").isNull() | (F.col("_in") == F.coalesce(low("container"), F.lit(""))))
    pairs = held.unionByName(holds).unionByName(shared).distinct().join(q, "query_id").join(e, "_e").filter(fits)
    exact = (F.col("_n") == F.col("_q")) | (F.col("_f") == F.col("_q")) | (F.col("_l") == F.col("_q"))
    part = F.col("_n").contains(F.col("_q")) | F.col("_f").contains(F.col("_q")) | ((F.length("_n") >= 4) & F.col("_q").contains(F.col("_n")))
    common = F.size(F.array_intersect("_ew", "_qw"))
    distance = F.when(exact, 0.0).when(part, 1.0).when(common > 0, F.lit(2.0) - common / F.greatest(F.size("_qw"), F.lit(1)))
    rows = pairs.withColumn("distance", distance).filter("distance IS NOT NULL").withColumn("match", F.when(exact, "exact").otherwise("fuzzy"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "entity_id", "source_kind"))
    rows = rows.withColumn("_m", F.explode("_members")).select(*[c for c in rows.columns if c != "_members"], "_m.*")
    return rows.withColumn("rank", rank).filter(F.col("rank") <= top).drop("_q", "_qw", "_kind", "_in", "_n", "_f", "_l", "_ew", "_e")


def with_evidence(entities: DataFrame, chunks: DataFrame, most: int = 500) -> DataFrame:
    """``entities`` (chunk_id, quote) with ``evidence``: the quote, else their chunk's text, cut at ``most``."""
    texts = chunks.select("chunk_id", F.left("text", F.lit(most)).alias("_text"))
    return entities.join(texts, "chunk_id", "left").withColumn("evidence", F.left(F.coalesce("quote", "_text", F.lit("")), F.lit(most))).drop("_text")


def api_lookup(queries: DataFrame, entities: DataFrame, chunks: DataFrame, documents: DataFrame, top: int = 10) -> DataFrame:
    """One row for each entity that a question of ``queries`` (query_id, api, kind, container, given) may mean, with its
    evidence, a warning if it is deprecated, and the check of the parameters given; mode ``entities``.

    ``entities``: entity_id, name, qualified, kind, container, source_kind, chunk_id, quote, deprecated, declared,
    required. Questions that mean none have one row with mode ``not_found``; where there are no entities at all,
    ``documents`` (query_id, chunk_id, rank) found for the questions are given, mode ``document_fallback``.
    """
    if entities.isEmpty():
        return documents.filter(F.col("rank") <= 5).select("query_id", F.lit("document_fallback").alias("mode"), "chunk_id", "rank")
    found = with_evidence(matched_entities(queries, entities, top), chunks).join(queries.select("query_id", "given"), "query_id")
    checked = check_parameters(found).withColumn("mode", F.lit("entities")).withColumn("warning", F.when(F.col("deprecated"), "deprecated"))
    rows = checked.select("query_id", "mode", "entity_id", "source_kind", "match", "distance", "rank", "chunk_id", "evidence", "warning", "unknown", "missing", "matched")
    lost = queries.join(rows.select("query_id"), "query_id", "left_anti").select("query_id", F.lit("not_found").alias("mode"))
    return rows.unionByName(lost, allowMissingColumns=True)


# --- entities without a model -----------------------------------------------------------------------------------------

#: How entities are recognised, and what is no name of one.
ERROR_CODE = r"(?<![A-Za-z0-9_])(?:E\d{2,}|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*_(?:ERROR|CODE|EXCEPTION))(?![A-Za-z0-9_])"
SIGNATURE = r"([A-Za-z_$][\w$.]+)\s*\(([^)]{0,400})\)"
DEPRECATED = r"(?i)@deprecated|已废弃|deprecated\s+since\s+([\w.\-]+)|废弃于\s*([\w.\-]+)"
NOISE = (
    "if", "for", "while", "switch", "return", "function", "class", "catch", "await", "async", "def", "fn", "func", "import", "export", "const", "let", "var", "new",
    "typeof", "instanceof", "in", "of", "do", "else", "try", "throw", "with", "super",
)


def heuristic_entities(sections: DataFrame) -> DataFrame:
    """(section, name, kind, signature, params, deprecated, since, confidence) of error codes and call signatures in
    ``sections`` (section, text): once for each name and kind, of equal names the first; keywords are no names."""
    text = F.col("text")
    codes = sections.select("section", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(ERROR_CODE), F.lit(0)))).alias("name"), F.lit("error_code").alias("kind"), F.lit(None).cast("string").alias("signature"), F.lit(None).cast("array<string>").alias("params"))
    calls = sections.select("section", F.posexplode(F.arrays_zip(F.regexp_extract_all(text, F.lit(SIGNATURE), F.lit(1)).alias("name"), F.regexp_extract_all(text, F.lit(SIGNATURE), F.lit(2)).alias("inside"))).alias("at", "c"))
    calls = calls.select("section", "at", "c.name", F.trim("c.inside").alias("inside")).filter(~F.lower(F.element_at(F.split("name", r"\."), -1)).isin(*NOISE))
    first = calls.groupBy("section", "name").agg(F.min_by("inside", "at").alias("inside"))
    params = F.transform(F.split("inside", ","), lambda p: F.regexp_replace(F.regexp_replace(F.trim(F.regexp_extract(p, r"^([^:=]*)", 1)), r"^\.\.\.", ""), r"\?$", ""))
    named = F.filter(F.transform(params, lambda p: F.trim(p)), lambda p: p.rlike("^[A-Za-z_$]"))
    calls = first.select("section", "name", F.lit("function").alias("kind"), F.concat("name", F.lit("("), "inside", F.lit(")")).alias("signature"), named.alias("params"))
    since = F.coalesce(F.nullif(F.regexp_extract(text, DEPRECATED, 1), F.lit("")), F.nullif(F.regexp_extract(text, DEPRECATED, 2), F.lit("")))
    old = sections.select("section", text.rlike(DEPRECATED).alias("deprecated"), since.alias("since"))
    return codes.unionByName(calls).join(old, "section").withColumn("confidence", F.lit(0.5))


# --- evidence ---------------------------------------------------------------------------------------------------------


def enveloped(text: Column, doc_id: Column, source: Column, built: Column, most: int = 2000) -> Column:
    """``text`` between marks that name where it is from; marks inside it and line ends in the names are made harmless."""
    attr = lambda c: F.regexp_replace(c, r'[\]"\r\n]', " ")
    safe = F.regexp_replace(F.regexp_replace(F.left(text, F.lit(most)), r"(?i)\[\s*/\s*KB-EVIDENCE\s*\]", "[ /KB-EVIDENCE ]"), r"(?i)\[\s*KB-EVIDENCE", "[ KB-EVIDENCE")
    return F.concat(F.lit('[KB-EVIDENCE doc_id="'), attr(doc_id), F.lit('" src="'), source, F.lit('" built_at="'), attr(built), F.lit('"]\n'), safe, F.lit("\n[/KB-EVIDENCE]"))


def requirement_evidence(hits: DataFrame, chunks: DataFrame, each: int = 500, total: int = 3000) -> DataFrame:
    """(query_id, block, chunks): the chunks found for a requirement, each cut at ``each``, as long as ``total`` lasts.

    ``hits`` (query_id, chunk_id, rank) are a search with the requirement's keywords.
    """
    rows = hits.filter(F.col("rank") <= total).join(chunks.select("chunk_id", F.left("text", F.lit(each)).alias("t")), "chunk_id")
    run = F.sum(F.length("t")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    kept = rows.withColumn("_run", run).filter(F.col("_run") <= total)
    parts = F.array_sort(F.collect_list(F.struct("rank", "t")))  # at most ``total`` of them
    return kept.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("block"), F.count(F.lit(1)).alias("chunks"))


def build(docs: DataFrame, version: str) -> dict[str, DataFrame]:
    """The tables of a base from ``docs`` (doc_id, title, text, links): documents, chunks, metadata, references, entities, postings."""
    from orrery.operators.retrieval import chunk, postings

    chunks = chunk(docs)
    sections = chunks.select(F.col("chunk_id").alias("section"), "text")
    return {
        "documents": docs.select("doc_id", "title"),
        "chunks": chunks,
        "meta": chunks.select("chunk_id", "doc_id", F.lit(version).alias("sdk_version")),
        "references": document_edges(docs),
        "entities": heuristic_entities(sections),
        "postings": postings(chunks),
    }


def publish_base(base: dict[str, DataFrame], path: str) -> None:
    """All tables of a base (``build``) at once, a reader finds the old base or the new one."""
    from orrery.sources.sinks import publish

    publish(base, path)


def open_bases(spark: SparkSession, vendor: str | None, project: str | None) -> tuple[dict[str, DataFrame | None], list[str]]:
    """(tables of both bases by name with their ``source_kind``, bases that aren't there): what is missing is no error."""
    from orrery.sources.sinks import current

    found = {kind: current(spark, path) if path else None for kind, path in (("vendor", vendor), ("project", project))}
    tables: dict[str, DataFrame | None] = {}
    for name in ("documents", "chunks", "meta", "references", "entities", "postings"):
        sides = [spark.read.parquet(f"{at}/{name}").withColumn("source_kind", F.lit(kind)) for kind, at in found.items() if at]
        tables[name] = sides[0].unionByName(sides[1]) if len(sides) == 2 else sides[0] if sides else None
    return tables, [kind for kind, at in found.items() if at is None]
