"""Plans of a run: budgets, packing, modes, keys, resumption, caches, fingerprints, drift and answers with citations."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions.durable import written
from orrery.functions.texts import excerpt, valid_iso

# --- budgets and order ------------------------------------------------------------------------------------------------

#: Tokens of the instructions of a module, tokens of an answer for each of a question, and characters of a
#: token, in texts with CJK characters and in others.
INSTRUCTIONS, OUTPUT, CJK_RATE, RATE = 6500, 0.3, 2.5, 3.8


def estimates(files: DataFrame) -> DataFrame:
    """(module, files, loc, input, output): what a module's files (module, path, text) will cost; files without text cost nothing."""
    rate = F.when(F.col("text").rlike(r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]"), CJK_RATE).otherwise(RATE)
    tokens = F.coalesce(F.ceil(F.length("text") / rate), F.lit(0))
    lines = F.coalesce(F.size(F.split("text", "\n")).cast("long"), F.lit(0).cast("long"))
    by = files.groupBy("module").agg(F.count(F.lit(1)).alias("files"), F.sum(lines).alias("loc"), (F.sum(tokens) + INSTRUCTIONS).alias("input"))
    return by.withColumn("output", F.floor(F.col("input") * OUTPUT + 0.5).cast("long"))


def dry_run(modules: DataFrame) -> DataFrame:
    """One row: modules, input and output tokens of all (``estimates``)."""
    return modules.agg(F.count(F.lit(1)).alias("modules"), F.coalesce(F.sum("input"), F.lit(0)).alias("input"), F.coalesce(F.sum("output"), F.lit(0)).alias("output"))


def budget_policy(total: Column, budget: Column, preset: Column, attempt: Column, terminal: Column) -> Column:
    """continue within the budget; beyond it what was preset, else cancel after an attempt or without a terminal, else ask."""
    return F.when(total <= budget, "continue").when(preset.isNotNull(), preset).when((attempt >= 1) | ~terminal, "cancel").otherwise("ask")


def relevant_callers(callers: DataFrame, top: int) -> DataFrame:
    """The first ``top`` callers (target, source, score) of each target: best scores, then ids."""
    w = Window.partitionBy("target").orderBy(F.desc("score"), "source")
    return callers.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def oldest(entries: DataFrame, top: int = 5) -> DataFrame:
    """The ``top`` entries (id, age) of the greatest age."""
    return entries.orderBy(F.desc("age"), "id").limit(top)


def packed(clusters: DataFrame, most: int = 15, budget: int = 85_000) -> DataFrame:
    """(cluster, id, cost, bin, oversized): clusters (cluster, id, cost) within the bounds stay one bin; others are packed,
    the costliest first, into the first bin with room. No item is lost: one beyond the budget has a bin of its own.

    One cluster is one task: it is what a model reads at once, not a table.
    """

    def pack(batch: pd.DataFrame) -> pd.DataFrame:
        if len(batch) <= most and batch["cost"].sum() <= budget:
            return batch.assign(bin=0, oversized=batch["cost"] > budget)
        batch = batch.sort_values(["cost", "id"], ascending=[False, True])
        bins: list[list[int]] = []  # of each bin its items and its cost
        out = []
        for cost in batch["cost"]:
            at = next((i for i, (n, c) in enumerate(bins) if n < most and c + cost <= budget), len(bins))
            if at == len(bins):
                bins.append([0, 0])
            bins[at][0] += 1
            bins[at][1] += cost
            out.append(at)
        return batch.assign(bin=out, oversized=batch["cost"] > budget)

    kinds = dict(clusters.dtypes)
    return clusters.select("cluster", "id", "cost").groupBy("cluster").applyInPandas(pack, f"cluster {kinds['cluster']}, id {kinds['id']}, cost {kinds['cost']}, bin int, oversized boolean")


def clustered(modules: DataFrame, members: DataFrame | None, least: int = 3) -> tuple[DataFrame, str]:
    """(modules with ``cluster``, method): by community where there are some, else by folder, else one; fewer than
    ``least`` modules (id, path) are one cluster. Modules without a community go by their folder."""
    if modules.limit(least).count() < least:
        return modules.withColumn("cluster", F.lit("all")), "single"
    folder = F.concat(F.lit("dir:"), F.coalesce(F.nullif(F.regexp_replace("path", r"/?[^/]*$", ""), F.lit("")), F.lit(".")))
    if members is not None and members.select("community").distinct().limit(2).count() > 1:
        by = modules.join(members.select("id", F.concat(F.lit("community:"), F.col("community").cast("string")).alias("_c")), "id", "left")
        return by.withColumn("cluster", F.coalesce("_c", folder)).drop("_c"), "community"
    by = modules.withColumn("cluster", folder)
    return (by, "directory") if by.select("cluster").distinct().limit(2).count() > 1 else (modules.withColumn("cluster", F.lit("all")), "single")


def highlights(nodes: DataFrame, top: int = 5) -> DataFrame:
    """The ``top`` nodes (id, label, degree) with the most edges; none without any."""
    return nodes.filter("degree > 0").orderBy(F.desc("degree"), "id").limit(top)


def report_edges(report: DataFrame, limit: int = 3) -> DataFrame:
    """(source, target, relation, across, confidence) of the first rows of the table of surprising connections in a report (text)."""
    part = F.regexp_extract("text", r"(?ms)^##\s+Surprising Connections[ \t]*$(.*?)(?=^##\s|\z)", 1)
    rows = report.select(F.posexplode(F.split(part, "\n")).alias("at", "l")).filter(F.col("l").startswith("|") & ~F.col("l").rlike(r"\|\s*Source\s*\||^\|[\s|:-]+\|$"))
    c = F.transform(F.split("l", r"\|"), lambda x: F.regexp_replace(F.trim(x), "^`|`$", ""))
    cells = rows.select("at", c.alias("c")).filter((F.size("c") >= 8) & (F.col("c")[1] != "") & (F.col("c")[2] != "")).orderBy("at").limit(limit)
    return cells.select(F.col("c")[1].alias("source"), F.col("c")[2].alias("target"), F.col("c")[3].alias("relation"), F.col("c")[4].isin("是", "yes").alias("across"), F.col("c")[5].alias("confidence"))


def regeneration_mode(full: bool | None = None, force: bool | None = None, incremental: bool | None = None) -> tuple[bool, bool, str]:
    """(incremental, full, reason): full and force go before an explicit choice, that before the default."""
    if full or force:
        return False, True, "full"
    return (True, False, "default") if incremental is None else (incremental, False, "incremental-explicit")


def cache_keys(groups: DataFrame) -> DataFrame:
    """``groups`` (grp, directory, files, language, split) with the ``key`` of their result: the folder, or the only file
    where several groups share a folder, with the language where a folder is split by it."""
    posix = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    shared = F.count(F.lit(1)).over(Window.partitionBy("directory")) > 1
    target = F.when(shared & (F.col("grp").cast("string") != "root") & (F.size("files") == 1), posix(F.col("files")[0])).otherwise(posix(F.col("directory")))
    return groups.withColumn("key", F.when(F.col("split") & F.col("language").isNotNull(), F.concat(target, F.lit("::"), "language")).otherwise(target))


# --- state ------------------------------------------------------------------------------------------------------------


def load_snapshot(spark: SparkSession, path: str, schema: str, version: str = "3.0") -> tuple[DataFrame | None, str]:
    """(rows, reason) of a published snapshot, a table with a ``schema_version``: ok, not-found, format-stale or corrupt.

    The version is looked at before the rows are, so an old snapshot isn't taken for a broken one.
    """
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    from orrery.sources.sinks import current

    at = current(spark, path)
    if at is None:
        return None, "not-found"
    try:
        seen = spark.read.schema("schema_version string").parquet(f"{at}/snapshot").agg(F.min("schema_version"), F.max("schema_version"), F.count(F.lit(1))).first()
        if seen[2] and (seen[0] != version or seen[1] != version):
            return None, "format-stale"
        rows = spark.read.schema(f"schema_version string, {schema}").parquet(f"{at}/snapshot")
        rows.agg(*[F.count(c) for c in rows.columns]).collect()  # every column is read once: a broken file shows
        return rows.drop("schema_version"), "ok"
    except (PySparkException, Py4JJavaError):
        return None, "corrupt"


def save_snapshot(rows: DataFrame, path: str, version: str = "3.0") -> None:
    from orrery.sources.sinks import publish

    publish({"snapshot": rows.withColumn("schema_version", F.lit(version))}, path)


def merge_state(state: DataFrame, done: DataFrame) -> DataFrame:
    """State (module, status, error) after ``done``: a module's newest status counts."""
    return state.join(done.select("module"), "module", "left_anti").unionByName(done)


def remaining(modules: DataFrame, state: DataFrame) -> DataFrame:
    """Modules that are not completed: a resumed run skips the others, and tries failed ones again."""
    return modules.join(state.filter("status = 'completed'").select("module"), "module", "left_anti")


def cache_plan(inputs: DataFrame, manifest: DataFrame, outputs: DataFrame) -> DataFrame:
    """(generator, key, hit) of ``inputs`` (generator, path, hash): a hit has a key that stands in the manifest (generator,
    key, output) with its output still there (``outputs``: path).

    A generator's key is a hash of its inputs' hashes in the order of their paths, made from sums that need no order in memory.
    """
    h = F.sha2(F.concat_ws("|", "path", "hash"), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string")
    keys = inputs.groupBy("generator").agg(part(0).alias("a"), part(1).alias("b"), F.count(F.lit(1)).cast("string").alias("n"))
    keys = keys.select("generator", F.substring(F.sha2(F.concat_ws("|", "generator", "a", "b", "n"), 256), 1, 16).alias("key"))
    known = manifest.join(outputs.select(F.col("path").alias("output")).distinct(), "output", "left_semi").select("generator", "key", F.lit(True).alias("hit")).distinct()
    return keys.join(known, ["generator", "key"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def on_surface(path: Column, extensions: list[str], case_sensitive: bool = False) -> Column:
    """Whether a file belongs to a collector: its name ends as one of ``extensions`` does, or has one of them in any case."""
    if case_sensitive:
        return F.array_contains(F.array(*[path.endswith(e) for e in extensions]), True)
    return F.lower(F.regexp_extract(path, r"(?<=[^/])(\.[^./]*)$", 1)).isin(*[e.lower() for e in extensions])


def fingerprint_verdict(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """(producer, verdict): same, changed, added or removed, of recorded and current fingerprints (producer, fingerprint); unknown without a record of it."""
    both = recorded.select("producer", F.col("fingerprint").alias("_o"), F.lit(True).alias("_r")).join(current.select("producer", F.col("fingerprint").alias("_n"), F.lit(True).alias("_c")), "producer", "full_outer")
    verdict = F.when(F.col("_r").isNull(), "added").when(F.col("_c").isNull(), "removed").when(F.col("_o").isNull(), "unknown").when(F.col("_o").eqNullSafe(F.col("_n")), "same").otherwise("changed")
    return both.select("producer", verdict.alias("verdict"))


def workflow_runs(log: DataFrame) -> DataFrame:
    """Finished runs of a workflow log (event_type, workflow, run_id, result, finished, duration): other events and records
    without a workflow, a run or a valid time are left out, results are lower-cased, missing ones unknown."""
    kept = log.filter((F.col("event_type") == "workflow_run") & F.col("workflow").isNotNull() & F.col("run_id").isNotNull()).filter(valid_iso(F.col("finished")))
    return kept.select("workflow", "run_id", F.coalesce(F.nullif(F.lower(F.trim("result")), F.lit("")), F.lit("unknown")).alias("result"), "finished", "duration")


# --- drift ------------------------------------------------------------------------------------------------------------


def member_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(parent, name, change, severity) of members array<struct<name, signature>> of exports (name, members) that both
    sides list: removed ones medium, added ones low, those with another signature medium."""
    both = old.select(F.col("name").alias("parent"), F.col("members").alias("o")).join(new.select(F.col("name").alias("parent"), F.col("members").alias("w")), "parent").filter("o IS NOT NULL AND w IS NOT NULL")
    o = both.select("parent", F.explode("o").alias("m")).select("parent", "m.name", F.col("m.signature").alias("os"), F.lit(True).alias("_o"))
    w = both.select("parent", F.explode("w").alias("m")).select("parent", "m.name", F.col("m.signature").alias("ws"), F.lit(True).alias("_w"))
    j = o.join(w, ["parent", "name"], "full_outer")
    change = F.when(F.col("_w").isNull(), "removal").when(F.col("_o").isNull(), "addition").when(~F.col("os").eqNullSafe(F.col("ws")), "modification")
    return j.select("parent", "name", change.alias("change")).filter("change IS NOT NULL").withColumn("severity", F.when(F.col("change") == "addition", "LOW").otherwise("MEDIUM"))


def drift_summary(items: DataFrame) -> DataFrame:
    """One row: drift items (change, severity) in all, by severity and by kind of change."""
    n = lambda c, v: F.count(F.when(F.col(c) == v, 1))
    return items.agg(
        F.count(F.lit(1)).alias("total"), n("severity", "HIGH").alias("high"), n("severity", "MEDIUM").alias("medium"), n("severity", "LOW").alias("low"),
        n("change", "addition").alias("additions"), n("change", "removal").alias("removals"), n("change", "modification").alias("modifications"),
    )


def baseline_diff(old: DataFrame, new: DataFrame, thresholds: DataFrame, mode: str = "regression") -> DataFrame:
    """(field, old_value, new_value, delta, severity) of metrics (field, value) by thresholds (field, yellow, red, two_sided,
    ratio, exact): green, yellow or red, and na where a side is missing.

    delta is in percent with one place, null where something came of nothing, which is red. A ratio is judged by its new
    value, which must not fall below; other metrics by the delta, on both sides or upwards only. For reproducibility
    there is no yellow, and an exact field must not change at all.
    """
    rows = thresholds.join(old.select("field", F.col("value").alias("old_value")), "field", "left").join(new.select("field", F.col("value").alias("new_value")), "field", "left")
    o, w = F.col("old_value"), F.col("new_value")
    na = o.isNull() | w.isNull()
    # halves go up, also below zero
    delta = F.when(na, None).when((o == 0) & (w == 0), 0.0).when(o != 0, F.floor((w - o) / o * 1000 + 0.5) / 10)
    tone = lambda x: F.when(x >= F.col("red"), "red").when(x >= F.col("yellow"), "yellow").otherwise("green")
    if mode == "reproducibility":
        severity = F.when(F.col("exact"), F.when(delta == 0, "green").otherwise("red")).otherwise(F.when(F.abs(delta) > F.col("red"), "red").otherwise("green"))
    else:
        low = F.when(w < F.col("red"), "red").when(w < F.col("yellow"), "yellow").otherwise("green")
        severity = F.when(F.col("ratio"), low).when(F.col("two_sided"), tone(F.abs(delta))).otherwise(tone(delta))
    out = F.when(na, "na").when((o == 0) & (w == 0), "green").when(o == 0, "red").otherwise(severity)
    return rows.select("field", "old_value", "new_value", delta.alias("delta"), out.alias("severity"))


def fill_rate(modules: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: modules (kind, file, calls) with a call site, files that should have some (``truth``: file), and their share, 0 of none."""
    n = modules.filter("kind = 'module' AND calls > 0").agg(F.countDistinct("file").alias("filled"))
    return n.join(F.broadcast(truth.agg(F.countDistinct("file").alias("denominator")))).withColumn("rate", F.when(F.col("denominator") > 0, F.col("filled") / F.col("denominator")).otherwise(0.0))


# --- answers ----------------------------------------------------------------------------------------------------------


def question_context(nodes: DataFrame, hyperedges: DataFrame, question: str) -> tuple[DataFrame, str | None]:
    """(hyperedges, mode) beside the nodes (id, rank) found for a question: those (id, label, nodes) whose label holds its
    first 30 characters and those of the first five nodes, once each; fewer than three nodes: rag-only."""
    start = question[:30].strip().lower()
    named = hyperedges.filter(F.lower("label").contains(start)) if start else hyperedges.limit(0)
    first = nodes.filter("rank <= 5").select("id").collect()  # five at most
    near = hyperedges.filter(F.arrays_overlap("nodes", F.array(*[F.lit(r.id) for r in first]))) if first else hyperedges.limit(0)
    found = named.unionByName(near)
    mode = "rag-only" if nodes.limit(3).count() < 3 else None
    return found.groupBy("id").agg(F.min(F.struct(*[c for c in hyperedges.columns if c != "id"])).alias("_h")).select("id", "_h.*"), mode


def retrieved(nodes: DataFrame, edges: DataFrame, hyperedges: DataFrame, question: str, budget: int = 20, depth: int = 2) -> tuple[DataFrame, DataFrame, str | None]:
    """(nodes, hyperedges, mode) for a question: the nodes (id, rank, depth, weight) that its words name and those around
    them, ranked and cut at ``budget``, the hyperedges beside them (``question_context``), and rag-only if nodes are few."""
    from orrery.operators.graph import question_subgraph

    found = question_subgraph(nodes, edges, question, budget, depth)
    order = Window.orderBy("tier", F.desc("weight"), "id")  # ``budget`` rows at most
    ranked = written(found.select("id", F.row_number().over(order).alias("rank"), "depth", "weight"), "retrieved")
    near, mode = question_context(ranked, hyperedges, question)
    return ranked, near, mode


def citations(chunks: DataFrame, nodes: DataFrame, debts: DataFrame, hyperedges: DataFrame, lines: DataFrame) -> DataFrame:
    """(place, path, first, last, excerpt, node, similarity): chunks by rank, then nodes, debts and hyperedges, in that order.

    ``chunks``: rank, path, first, last, text, node, label, similarity; ``nodes``: rank, id, label, spec (a path, or
    path:first-last); ``debts``: rank, path, first, last, text; ``hyperedges``: rank, rationale. A range beyond the lines of
    its file (``lines``: path, n) is left out; of files that aren't known nothing is left out.
    """
    c = chunks.select(F.lit(0).alias("o"), "rank", "path", "first", "last", excerpt(F.col("text"), F.coalesce("label", "node")).alias("excerpt"), "node", "similarity")
    at = r"^(.*):(\d+)-(\d+)$"
    ranged = F.col("spec").rlike(at)
    of = lambda i, other: F.when(ranged, F.regexp_extract("spec", at, i).cast("int")).otherwise(other)
    told = nodes.filter("spec IS NOT NULL AND spec <> ''")
    n = told.select(F.lit(1).alias("o"), "rank", F.when(ranged, F.regexp_extract("spec", at, 1)).otherwise(F.col("spec")).alias("path"), of(2, 1).alias("first"), of(3, 1).alias("last"), F.concat(F.lit("["), "label", F.lit("]")).alias("excerpt"), F.col("id").alias("node"), ranged.alias("_ranged"))
    d = debts.select(F.lit(2).alias("o"), "rank", "path", "first", "last", F.left("text", F.lit(200)).alias("excerpt"))
    h = hyperedges.select(F.lit(3).alias("o"), "rank", F.lit("[graph hyperedge]").alias("path"), F.lit(0).alias("first"), F.lit(0).alias("last"), F.left("rationale", F.lit(200)).alias("excerpt"))
    every = c.withColumn("_ranged", F.lit(True)).unionByName(n, allowMissingColumns=True).unionByName(d.unionByName(h).withColumn("_ranged", F.lit(False)), allowMissingColumns=True)
    known = every.join(lines.select("path", F.col("n").alias("_n")), "path", "left")
    fits = ~F.col("_ranged") | F.col("_n").isNull() | (F.col("_n") == 0) | ((F.col("first") <= F.col("_n")) & (F.col("last") <= F.col("_n"))) | ((F.col("first") == 0) & (F.col("last") == 0))
    place = F.row_number().over(Window.orderBy("o", "rank", "path"))  # an answer's citations: some dozens
    return known.filter(fits).withColumn("place", place).select("place", "path", "first", "last", "excerpt", "node", "similarity")


def proportion_interval(rows: DataFrame, column: str, key: str, rounds: int = 200, seed: int = 7, alpha: float = 0.05) -> DataFrame:
    """(low, high, samples): percentile interval of the mean of a column of 0 and 1 over Poisson resamples, null for fewer
    than three rows. ``key`` tells rows apart: a row's weight in a round is a hash of both, so reruns agree.

    Every task adds up its rows' weights for all rounds, so what is shuffled is a row for each round and task."""
    hashed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    half = lambda at: F.conv(F.substring(hashed, at, 8), 16, 10).cast("long")
    known = rows.filter(F.col(column).isNotNull()).select(F.col(column).cast("int").alias("v"), half(1).alias("hi"), half(9).alias("lo"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        steps = np.array([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563])
        each = np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        weight, good, n = np.zeros(rounds, np.int64), np.zeros(rounds, np.int64), 0
        for b in batches:
            h = (b["hi"].to_numpy(np.uint64) << np.uint64(32)) | b["lo"].to_numpy(np.uint64)
            v = b["v"].to_numpy(np.int64)
            for at in range(0, len(h), 4096):
                z = h[at : at + 4096, None] + each[None, :]  # a mixing of 64 bits, modulo their power of two
                z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                w = np.searchsorted(steps, ((z ^ (z >> np.uint64(31))) >> np.uint64(34)) / float(1 << 30), side="right")
                weight += w.sum(0)
                good += (w * v[at : at + 4096, None]).sum(0)
            n += len(h)
        yield pd.DataFrame({"round": np.arange(rounds), "w": weight, "g": good, "n": n})

    means = known.mapInPandas(run, "round int, w long, g long, n long").groupBy("round").agg(F.try_divide(F.sum("g"), F.sum("w")).alias("m"), F.sum("n").alias("n"))
    low, high = math.floor(alpha / 2 * rounds), min(rounds - 1, math.ceil((1 - alpha / 2) * rounds) - 1)
    sums = means.agg(F.array_sort(F.collect_list("m")).alias("m"), F.coalesce(F.max("n"), F.lit(0)).alias("samples"))  # a number for each round
    some = F.col("samples") >= 3
    return sums.select(F.when(some, F.get("m", F.lit(low))).alias("low"), F.when(some, F.get("m", F.lit(high))).alias("high"), "samples")
