"""Code facts to graphs: call sites, import and receiver resolution, the merge of all sources, surfaces and manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.expressions import tier_level
from orrery.functions.texts import endpoint_tag, method_rank, path_parameters
from orrery.operators.graph import DIRECTIONAL, upsert_edges, upsert_nodes, valid_edges

# --- calls and imports ------------------------------------------------------------------------------------------------


def call_sites(skeletons: DataFrame) -> DataFrame:
    """(caller_file, at, ...) of every call site in ``skeletons`` (file, call_sites array<struct>), in file order."""
    return skeletons.select(F.col("file").alias("caller_file"), F.posexplode("call_sites").alias("at", "c")).select("caller_file", "at", "c.*")


#: Extensions tried in this order, index files, what a JavaScript extension may stand for, and what is no source.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
INDEX = ("index.ts", "index.tsx", "index.js", "index.jsx")
STANDS_FOR = {".js": (".ts", ".tsx"), ".jsx": (".tsx",), ".mjs": (".mts",), ".cjs": (".cts",)}
NO_SOURCE = r"\.(json|css|scss|less|svg|png|jpe?g|gif|wasm)$|\.d\.ts$"


def normal_path(path: Column) -> Column:
    """A relative path without . and .. segments; null if it leaves the root."""
    start = F.struct(F.array().cast("array<string>").alias("p"), F.lit(False).alias("out"))

    def step(a: Column, s: Column) -> Column:
        up = (s == "..") & ~a["out"]
        kept = F.when(up & (F.size(a["p"]) > 0), F.slice(a["p"], F.lit(1), F.greatest(F.size(a["p"]) - 1, F.lit(0)))).when((s == ".") | (s == "") | (s == ".."), a["p"]).otherwise(F.concat(a["p"], F.array(s)))
        return F.struct(kept.alias("p"), (a["out"] | (up & (F.size(a["p"]) == 0))).alias("out"))

    done = F.aggregate(F.split(path, "/"), start, step)
    return F.transform(F.array(done), lambda d: F.when(~d["out"], F.array_join(d["p"], "/")))[0]


def candidates(base: Column) -> Column:
    """Files that a specifier may mean, the first that exists wins: itself, what its extension stands for, with an extension, its index."""
    own = [F.when(base.endswith(js), F.concat(F.regexp_replace(base, rf"\{js}$", ""), F.lit(ts))) for js, every in STANDS_FOR.items() for ts in every]
    return F.array_compact(F.array(F.when(base.rlike(r"\.[cm]?[jt]sx?$"), base), *own, *[F.concat(base, F.lit(e)) for e in EXTENSIONS], *[F.concat(base, F.lit("/" + i)) for i in INDEX]))


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: DataFrame | None = None, base: str | None = None) -> DataFrame:
    """``imports`` (file, specifier) with ``resolved`` and ``kind``: relative, paths-alias, absolute, external or unresolved.

    ``files`` (path) are those of the project, relative to its root; ``aliases`` (pattern, replacement, both with at most
    one *) are tried by the longest pattern first, then ``base`` as a folder of bare specifiers. Specifiers of modules
    of the runtime and of packages are external, as are files that are no source; a path that leaves the root isn't resolved.
    """
    spec = F.col("specifier")
    rel = spec.startswith(".")
    folder = F.regexp_replace("file", r"[^/]*$", "")
    rows = imports.withColumn("_id", F.monotonically_increasing_id())
    rows = rows.withColumn("_base", F.when(rel, normal_path(F.concat(folder, spec))))
    tries = rows.filter(rel & ~spec.rlike(NO_SOURCE) & F.col("_base").isNotNull()).select("_id", F.lit("relative").alias("k"), F.lit(0).alias("o"), F.col("_base").alias("b"))
    bare = rows.filter(~rel & (spec != "") & ~spec.startswith("node:") & ~spec.startswith("/"))
    if aliases is not None:
        a = aliases.withColumn("_pre", F.regexp_extract("pattern", r"^([^*]*)", 1)).withColumn("_post", F.regexp_extract("pattern", r"\*(.*)$", 1))
        fits = F.when(F.col("pattern").contains("*"), spec.startswith(F.col("_pre")) & spec.endswith(F.col("_post")) & (F.length(spec) >= F.length("_pre") + F.length("_post"))).otherwise(spec == F.col("pattern"))
        middle = F.substring(spec, F.length("_pre") + 1, F.length(spec) - F.length("_pre") - F.length("_post"))
        # a project has a handful of aliases
        hit = bare.join(F.broadcast(a), fits).select("_id", F.lit("paths-alias").alias("k"), (100 - F.length("_pre")).alias("o"), normal_path(F.replace("replacement", F.lit("*"), middle)).alias("b"))
        tries = tries.unionByName(hit.filter("b IS NOT NULL"))
    if base is not None:
        tries = tries.unionByName(bare.select("_id", F.lit("absolute").alias("k"), F.lit(1000).alias("o"), normal_path(F.concat(F.lit(base.rstrip("/") + "/"), spec)).alias("b")).filter("b IS NOT NULL"))
    each = tries.select("_id", "k", "o", F.posexplode(candidates(F.col("b"))).alias("at", "path"))
    first = each.join(files.select("path").distinct(), "path").groupBy("_id").agg(F.min_by(F.struct("path", "k"), F.struct("o", "at")).alias("f"))
    other = (
        F.when(spec.isNull() | (spec == ""), "unresolved").when(spec.startswith("node:"), "external").when(spec.startswith("/"), "unresolved")
        .when(rel, F.when(spec.rlike(NO_SOURCE), "external").otherwise("unresolved")).when(spec.rlike(r"^([~#$]|@)/"), "unresolved")
        .when(spec.startswith("@") | spec.rlike(r"^[a-z0-9][a-z0-9-_.]*(/|$)"), "external").otherwise("unresolved")
    )
    out = rows.join(first, "_id", "left")
    return out.select(*imports.columns, F.col("f.path").alias("resolved"), F.coalesce("f.k", other).alias("kind"))


def resolve_receivers(calls: DataFrame, exports: DataFrame, imports: DataFrame) -> DataFrame:
    """(source, target, relation, confidence) of calls on a receiver whose class is known.

    ``calls``: source, caller_file, callee, receiver, sole_binding, sole_import. A class of the caller's own file counts if
    the name is bound once there; else an import of that name, if it is bound by that import alone and is neither
    renamed, nor a default import, nor loaded at run time. The class must be exported (not passed on) as a class and own
    the callee. ``exports``: file, at, name, kind, members; ``imports``: file, alias, target, renamed, default, dynamic.
    """
    own = exports.filter("kind <> 're-export'").groupBy("file", "name").agg(F.min_by(F.struct("kind", "members"), "at").alias("e")).select("file", "name", "e.*")
    c = calls.filter("receiver IS NOT NULL").withColumn("_id", F.monotonically_increasing_id())
    here = own.select(F.col("file").alias("caller_file"), F.col("name").alias("receiver"), F.lit(True).alias("_local")).distinct()
    flags = imports.groupBy(F.col("file").alias("caller_file"), F.col("alias").alias("receiver")).agg(
        F.min("target").alias("_target"), F.max(F.coalesce("renamed", F.lit(False))).alias("_r"), F.max(F.coalesce("default", F.lit(False))).alias("_d"), F.max(F.coalesce("dynamic", F.lit(False))).alias("_y")
    )
    rows = c.join(here, ["caller_file", "receiver"], "left").join(flags, ["caller_file", "receiver"], "left").filter(~F.coalesce("_y", F.lit(False)))
    imported = F.coalesce("sole_import", F.lit(False)) & ~F.coalesce("_r", F.lit(False)) & ~F.coalesce("_d", F.lit(False))
    at = F.when(F.col("_local"), F.when(F.col("sole_binding"), F.col("caller_file"))).when(imported, F.col("_target"))
    owner = own.filter("kind = 'class'").select(F.col("file").alias("_file"), F.col("name").alias("receiver"), "members")
    hit = rows.withColumn("_file", at).join(owner, ["_file", "receiver"]).filter(F.expr("array_contains(members, callee)"))
    return hit.select("source", F.concat("_file", F.lit("::"), "receiver", F.lit("."), "callee").alias("target"), F.lit("calls").alias("relation"), F.lit("medium").alias("confidence"))


# --- the graph of all sources -----------------------------------------------------------------------------------------

#: Sources in the order in which later ones overwrite earlier ones, and relations whose direction an undirected graph notes.
SOURCES = ("doc_graph", "architecture_ir", "cross_reference", "extraction", "unified_graph")
NOTED = ("contains", "groups", "deploys")


def from_unified(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, label, file, language, metadata) and edges (source, target, relation, tier, evidence) of the unified
    form as persisted ones: symbols are components, tiers levels, evidence at most 200 characters, the language is dropped."""
    symbol = F.col("kind") == "symbol"
    more = F.map_filter(F.create_map(F.lit("unifiedKind"), F.when(symbol, "symbol"), F.lit("sourcePath"), F.col("file")), lambda k, v: v.isNotNull())
    n = nodes.select("id", F.when(symbol, "component").otherwise(F.col("kind")).alias("kind"), "label", F.map_concat(F.coalesce("metadata", F.create_map().cast("map<string,string>")), more).alias("metadata"))
    level = tier_level(F.col("tier"))
    e = edges.select("source", "target", "relation", level.alias("confidence"), F.when(level == "EXTRACTED", 0.95).when(level == "INFERRED", 0.65).otherwise(0.25).alias("score"), F.left("evidence", F.lit(200)).alias("evidence"))
    return n, e


def build_graph(sources: dict[str, tuple[DataFrame, DataFrame] | None], directed: bool = True) -> tuple[DataFrame, DataFrame, list[str]]:
    """(nodes, edges, skipped sources) of all sources: nodes (id, kind, label, metadata), edges (source, target, relation, confidence, score, evidence).

    A later source's label and kind win and its metadata is added; of the last source only what is missing. Edges with
    a missing end are left out; of equal ones the best score wins with all its columns. An undirected graph has one edge
    for both directions of a relation and notes as ``original_direction`` the one that was kept where that says something.
    """
    skipped = [s for s in SOURCES if sources.get(s) is None]
    here = [(rank, sources[s]) for rank, s in enumerate(SOURCES) if sources.get(s) is not None]
    if not here:
        raise ValueError("no source is there; skipped: " + ", ".join(skipped))
    # the last source supplements: as the earliest it overwrites nothing
    ranked = [n.select("id", F.lit(rank if rank < len(SOURCES) - 1 else -1).alias("rank"), "label", "kind", "metadata") for rank, (n, _) in here]
    nodes = upsert_nodes(reduce(DataFrame.unionByName, ranked)).select("id", "kind", "label", "metadata")
    edges = valid_edges(reduce(DataFrame.unionByName, [e.select("source", "target", "relation", "confidence", "score", "evidence") for _, (_, e) in here]), nodes)
    edges = upsert_edges(edges.withColumn("directional", F.col("relation").isin(*DIRECTIONAL)), directed)
    if not directed:
        edges = edges.withColumn("original_direction", F.when(F.col("relation").isin(*NOTED), F.col("original_direction")))
    return nodes, edges, skipped


def union_module_graphs(graphs: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Module graphs (nodes, edges) of several languages as one, each row once."""
    return tuple(reduce(DataFrame.unionByName, part).distinct() for part in zip(*graphs, strict=True))


def semantic_lookup(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, source, target, relation, score): the edges of each of ``ids`` that a text was the reason for."""
    e = edges.filter(F.col("relation").isin("references", "conceptually_related_to", "mentions"))
    out = ids.join(e, F.col("id") == F.col("source")).select("id", "source", "target", "relation", "score")
    return out.unionByName(ids.join(e.filter("source <> target"), F.col("id") == F.col("target")).select("id", "source", "target", "relation", "score"))


def directory_graph(files: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) by folder, where nothing is parsed: files (path) are counted, imports (file, resolved) between folders summed."""
    folder = lambda c: F.coalesce(F.nullif(F.regexp_replace(c, r"/?[^/]*$", ""), F.lit("")), F.lit("."))
    nodes = files.groupBy(folder(F.col("path")).alias("id")).agg(F.count(F.lit(1)).alias("files"))
    pairs = imports.filter("resolved IS NOT NULL").select(folder(F.col("file")).alias("source"), folder(F.col("resolved")).alias("target")).filter("source <> target")
    return nodes, pairs.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


# --- surfaces, models and manifests -----------------------------------------------------------------------------------


def api_surface(endpoints: DataFrame) -> DataFrame:
    """(path, method, parameters, responses, tags, operation_id, file, rank) once for each method and path, by path and method.

    ``endpoints``: path, method, parameters, responses, tags (arrays), operation_id, file, seq. Arrays are joined, of single
    values the first that is there is kept; without a tag the path's subject is one.
    """
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    by = endpoints.groupBy("path", F.upper("method").alias("method")).agg(
        every(F.coalesce("parameters", F.array().cast("array<string>"))).alias("p"), every(F.coalesce("responses", F.array().cast("array<string>"))).alias("responses"), every(F.coalesce("tags", F.array().cast("array<string>"))).alias("tags"),
        F.min_by("operation_id", F.when(F.col("operation_id").isNotNull(), F.col("seq"))).alias("operation_id"), F.min_by("file", F.when(F.col("file").isNotNull(), F.col("seq"))).alias("file"),
    )
    tags = F.when(F.size("tags") > 0, F.col("tags")).otherwise(F.array(endpoint_tag(F.col("path"), F.coalesce("file", F.lit("")))))
    parameters = F.array_sort(F.array_distinct(F.concat(path_parameters(F.col("path")), "p")))
    return by.select("path", "method", parameters.alias("parameters"), "responses", tags.alias("tags"), "operation_id", "file", method_rank(F.col("method")).alias("rank"))


def interface_surface(skeletons: DataFrame) -> DataFrame:
    """(file, name, kind, members) of what files export themselves."""
    return skeletons.select("file", F.explode("exports").alias("e")).filter("NOT coalesce(e.reexport, false)").select("file", "e.name", "e.kind", F.size("e.members").alias("members"))


def data_model(entities: DataFrame) -> DataFrame:
    """(source, target, relation) of ``entities`` (name, parents, fields array<struct<name, type>>): inherits, has and, of collections, contains.

    Types are taken apart into their words, so that each is looked up by name.
    """
    known = entities.select(F.col("name").alias("target")).distinct()
    parents = entities.select(F.col("name").alias("source"), F.explode("parents").alias("target"), F.lit("inherits").alias("relation"))
    fields = entities.select(F.col("name").alias("source"), F.explode("fields").alias("f"))
    many = F.col("f.type").rlike(r"(?i)(\[\]|\b(list|array|set|map|dict|sequence|iterable)\b)")
    words = F.array_distinct(F.regexp_extract_all(F.col("f.type"), F.lit(r"[A-Za-z_]\w*"), F.lit(0)))
    has = fields.select("source", F.explode(words).alias("target"), F.when(many, "contains").otherwise("has").alias("relation"))
    return parents.unionByName(has).filter("source <> target").join(known, "target", "left_semi").select("source", "target", "relation").distinct()


def config_reference(entries: DataFrame) -> DataFrame:
    """(path, keys, types) of configuration entries (path, key, type): a row for each file."""
    return entries.groupBy("path").agg(F.count(F.lit(1)).alias("keys"), F.array_sort(F.collect_set("type")).alias("types"))


def troubleshooting(entities: DataFrame, sources: DataFrame) -> DataFrame:
    """(name, sources) of error codes (name, kind, section) and the files (section, file) that mention them."""
    hit = entities.filter("kind = 'error_code'").join(sources, "section").select("name", "file").distinct()
    return hit.groupBy("name").agg(F.count(F.lit(1)).alias("sources"), F.min("file").alias("first"))


def verified_evidence(refs: DataFrame, files: DataFrame) -> DataFrame:
    """``refs`` (ref, source, location, snippet) with ``verified`` and a reason: file-not-found, invalid-location-format,
    line-out-of-range or snippet-mismatch. ``files``: path, text; locations are L3 or L3-L7; a snippet is compared without
    regard to white space and has to be part of the lines."""
    at = r"^L?(\d+)(?:-L?(\d+))?$"
    first, last = F.regexp_extract("location", at, 1).try_cast("int"), F.coalesce(F.regexp_extract("location", at, 2).try_cast("int"), F.regexp_extract("location", at, 1).try_cast("int"))
    rows = refs.join(files.select(F.col("path").alias("source"), F.split("text", "\n").alias("_l")), "source", "left").withColumn("_a", first).withColumn("_b", last)
    bare = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    lines = F.array_join(F.slice("_l", F.greatest(F.col("_a"), F.lit(1)), F.greatest(F.col("_b") - F.col("_a") + 1, F.lit(0))), "\n")
    reason = (
        F.when(F.col("_l").isNull(), "file-not-found").when(F.col("_a").isNull() | (F.col("_a") < 1) | (F.col("_b") < F.col("_a")), "invalid-location-format")
        .when(F.col("_b") > F.size("_l"), "line-out-of-range").when(~bare(lines).contains(bare(F.col("snippet"))), "snippet-mismatch")
    )
    return rows.withColumn("reason", reason).select(*refs.columns, F.col("reason").isNull().alias("verified"), "reason")


def merged_environment(settings: DataFrame) -> DataFrame:
    """(service, name, value): of settings (service, name, value, rank) the one of the greatest rank, later sources overwrite."""
    return settings.groupBy("service", "name").agg(F.max_by("value", "rank").alias("value"))


def docs_bundle(profile: DataFrame, documents: DataFrame) -> DataFrame:
    """(profile, place, doc_id) of the documents (doc_id, kind) that a profile (profile, place, kind) lists, in its order, by id within a kind."""
    w = Window.partitionBy("profile").orderBy("place", "doc_id")
    return profile.join(documents, "kind").select("profile", F.row_number().over(w).alias("place"), "doc_id", "kind")


def workspace_packages(manifests: DataFrame, globs: list[str]) -> tuple[DataFrame, DataFrame]:
    """(packages, dependencies) of a workspace's npm manifests (path, text) below ``globs`` (each with * for one folder).

    packages: name, folder, version, grp (the first folder); dependencies: source, target, of packages of the workspace only.
    """
    schema = "name string, version string, dependencies map<string,string>, devDependencies map<string,string>"
    within = "|".join("^" + "[^/]+".join(part.replace(".", r"\.") for part in g.rstrip("/").split("*")) + "$" for g in globs)
    rows = manifests.select(F.regexp_replace("path", r"/?package\.json$", "").alias("folder"), F.from_json("text", schema).alias("m"))
    rows = rows.filter(F.col("folder").rlike(within) & F.col("m.name").isNotNull())
    packages = rows.select("m.name", "folder", "m.version", F.split("folder", "/")[0].alias("grp"))
    empty = F.create_map().cast("map<string,string>")
    each = rows.select(F.col("m.name").alias("source"), F.explode(F.array_distinct(F.concat(F.map_keys(F.coalesce("m.dependencies", empty)), F.map_keys(F.coalesce("m.devDependencies", empty))))).alias("target"))
    return packages, each.join(packages.select(F.col("name").alias("target")), "target", "left_semi").select("source", "target")
