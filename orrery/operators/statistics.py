"""Statistics, cost and evaluation aggregates, change detection and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.expressions import clamp, ratio

Z = 1.96


def wilson(good: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of the interval of a proportion, clamped to 0..1; null without observations."""
    p = good / n
    centre = p + Z * Z / (2 * n)
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    bottom = 1 + Z * Z / n
    return clamp((centre - half) / bottom, 0.0, 1.0), clamp((centre + half) / bottom, 0.0, 1.0)


def multiset_jaccard(a: DataFrame, b: DataFrame, key: str, group: str) -> DataFrame:
    """(group, jaccard): sum of lesser counts over sum of greater ones; groups without any item don't occur."""
    both = a.select(group, key, F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(group, key, F.lit(0).alias("x"), F.lit(1).alias("y")))
    counts = both.groupBy(group, key).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    return counts.groupBy(group).agg((F.sum(F.least("x", "y")) / F.sum(F.greatest("x", "y"))).alias("jaccard"))


def precision_recall(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """One row, three places; null for an empty denominator. Sets, so repeated rows count once."""
    f, t = found.select(*keys).distinct().withColumn("f", F.lit(1)), truth.select(*keys).distinct().withColumn("t", F.lit(1))
    row = f.join(t, keys, "full_outer").agg(F.count("f").alias("found"), F.count("t").alias("truth"), F.count(F.when(F.col("f").isNotNull() & F.col("t").isNotNull(), 1)).alias("both"))
    return row.select("*", F.round(ratio(F.col("both"), F.col("found"), None), 3).alias("precision"), F.round(ratio(F.col("both"), F.col("truth"), None), 3).alias("recall"))


def bootstrap_median(values: DataFrame, column: str, rounds: int = 200, seed: int = 7, alpha: float = 0.05) -> DataFrame:
    """(low, high): percentile interval of the median over Poisson resamples, null for fewer than three rows: every row draws
    its weight in each round from a hash of row and round, so rounds are one aggregation and nothing is collected.
    Equal rows are counted first and told apart by their number, so each draws for itself."""
    counted = values.groupBy(*values.columns).agg(F.count(F.lit(1)).alias("_n"))
    each = counted.select(F.col(column).alias("v"), F.xxhash64(*values.columns).alias("_h"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_k"))
    drawn = each.select("v", F.xxhash64("_h", "_k").alias("h"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    u = F.pmod(F.xxhash64("h", "round", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563]
    weight = sum(F.when(u >= s, 1).otherwise(0) for s in steps)
    medians = drawn.withColumn("w", weight).filter("w > 0").groupBy("round").agg(F.expr("percentile(v, 0.5, w)").alias("m"))
    return medians.agg(F.expr(f"percentile(m, {alpha / 2})").alias("low"), F.expr(f"percentile(m, {1 - alpha / 2})").alias("high"), F.count(F.lit(1)).alias("rounds")) if values.limit(3).count() >= 3 else values.sparkSession.createDataFrame([(None, None, 0)], "low double, high double, rounds long")


def latest(rows: DataFrame, keys: list[str], time: str, seq: str) -> DataFrame:
    """The row of each key with the latest time, ties and missing times to the later one in file order."""
    best = F.max_by(F.struct(*rows.columns), F.struct(F.coalesce(F.col(time).cast("timestamp"), F.to_timestamp(F.lit("1970-01-01"))), F.col(seq)))
    return rows.groupBy(*keys).agg(best.alias("_r")).select("_r.*")


def run_metrics(runs: DataFrame, workflows: DataFrame) -> DataFrame:
    """Per workflow, those without a run included: counts by result, rates, mean duration, last run."""
    n = F.count("run_id")
    agg = workflows.join(runs, "workflow", "left").groupBy("workflow").agg(
        n.alias("runs"), F.count(F.when(F.col("result") == "success", 1)).alias("success"), F.count(F.when(F.col("result") == "failure", 1)).alias("failure"),
        F.avg("duration").alias("mean_duration"), F.max("finished").alias("last_run"),
    )
    return agg.withColumn("success_rate", ratio(F.col("success"), F.col("runs"), 0.0)).withColumn("failure_rate", ratio(F.col("failure"), F.col("runs"), 0.0))


def coverage_gap(records: DataFrame, least: int = 2) -> DataFrame:
    """Terms of records (query, tool, time, terms) that found nothing, asked in ``least`` different queries or more."""
    each = records.select("query", "tool", "time", F.explode(F.array_distinct("terms")).alias("term"))
    out = each.groupBy("term").agg(
        F.count(F.lit(1)).alias("occurrences"), F.countDistinct("query").alias("queries"), F.array_sort(F.collect_set("tool")).alias("tools"), F.min("time").alias("first_seen"), F.max("time").alias("last_seen")
    )
    return out.filter(F.col("queries") >= least)


def cost_summary(costs: DataFrame) -> DataFrame:
    """Per model (empty: ast-only) sums, calls and share of the total in percent, one place; 0 of nothing."""
    model = F.coalesce(F.nullif(F.col("model"), F.lit("")), F.lit("ast-only"))
    by = costs.groupBy(model.alias("model")).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("calls"))
    total = by.agg(F.sum("tokens").alias("total"))
    return by.join(F.broadcast(total)).select("model", "tokens", "calls", F.round(ratio(F.col("tokens") * 100, F.col("total"), 0.0), 1).alias("share"))


def age_bucket(days: Column) -> Column:
    return F.when(days < 30, "<30").when(days < 90, "30-90").when(days < 180, "90-180").otherwise(">=180")


def quality_score(high: Column, medium: Column, low: Column, missing: Column, partial: Column, low_coverage: Column, warnings: Column) -> Column:
    return clamp(100 - 20 * high - 10 * medium - 5 * low - 8 * missing - 4 * partial - 3 * low_coverage - 2 * warnings, 0, 100)


def stale_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, reason) of (path, hash) snapshots: changed, new or gone."""
    both = old.select("path", F.col("hash").alias("o")).join(new.select("path", F.col("hash").alias("w")), "path", "full_outer")
    reason = F.when(F.col("o").isNull(), "new").when(F.col("w").isNull(), "gone").when(F.col("o") != F.col("w"), "changed")
    return both.select("path", reason.alias("reason")).filter("reason IS NOT NULL")


def delta_plan(specs: DataFrame, current: DataFrame) -> DataFrame:
    """(path, reason): why a document is made again, the first reason that applies; null: unchanged."""
    both = current.join(specs.select("path", F.col("hash").alias("old"), F.col("mode").alias("old_mode"), F.lit(True).alias("known")), "path", "left")
    reason = (
        F.when(F.col("known").isNull(), "missing-spec").when(F.col("old").isNull(), "metadata-missing")
        .when(F.col("old") != F.col("hash"), "skeleton-changed").when(F.col("old_mode") != F.col("mode"), "mode-changed")
    )
    return both.select("path", reason.alias("reason"))


def structural_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, change, severity) of (name, signature, type_parameters): removed high, added low, changed medium."""
    both = old.select("name", F.struct("signature", "type_parameters").alias("o")).join(new.select("name", F.struct("signature", "type_parameters").alias("w")), "name", "full_outer")
    change = (
        F.when(F.col("w").isNull(), "removed").when(F.col("o").isNull(), "added")
        .when(F.col("o.signature") != F.col("w.signature"), "signature").when(~F.col("o.type_parameters").eqNullSafe(F.col("w.type_parameters")), "type-parameters")
    )
    severity = F.when(change == "removed", "HIGH").when(change == "added", "LOW").otherwise("MEDIUM")
    return both.select("name", change.alias("change"), severity.alias("severity")).filter("change IS NOT NULL")


def normal_code(text: Column) -> Column:
    """Without comments, white space, semicolons and trailing commas: equal texts drift by noise only."""
    out = F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", ""), r"//[^\n]*", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\s+", ""), ";", "")
    return F.regexp_replace(out, r",([\])}])", "$1")


def sessions(events: DataFrame, gap: str, key: str, time: str, item: str) -> DataFrame:
    """Changes of a key coalesced until it was quiet for ``gap``; runs on streams as well (with a watermark)."""
    by = events.groupBy(F.col(key), F.session_window(time, gap).alias("w"))
    return by.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(item)).alias("items")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "items")


def longest_prefix(files: DataFrame, directories: DataFrame) -> DataFrame:
    """(path, directory): the deepest directory above each file. Ancestors are exploded (a path's depth), so the join is an equi-join."""
    parts = F.split("path", "/")
    above = files.select("path", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k"), parts.alias("p")).withColumn("directory", F.array_join(F.slice("p", F.lit(1), F.col("k")), "/"))
    hit = above.join(directories.select("directory"), "directory")
    return hit.groupBy("path").agg(F.max_by("directory", "k").alias("directory"))


def rolled_up(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Distinct edges between the groups (id, grp) of their ends."""
    a, b = groups.select(F.col("id").alias("source"), F.col("grp").alias("a")), groups.select(F.col("id").alias("target"), F.col("grp").alias("b"))
    return edges.join(a, "source").join(b, "target").filter("a <> b").select("a", "b").distinct()


def stratified(rows: DataFrame, rate: str, per_bin: int, seed: int) -> DataFrame:
    """(id, bin, rank): at most ``per_bin`` of each of three bins of ``rate``, in the order of a seeded hash."""
    bins = F.when(F.col(rate) < 0.33, "low").when(F.col(rate) <= 0.67, "mid").otherwise("high")
    order = F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}")))
    ranked = rows.withColumn("bin", bins).withColumn("rank", F.row_number().over(Window.partitionBy("bin").orderBy(order)))
    return ranked.filter(F.col("rank") <= per_bin).select("id", "bin", "rank")
