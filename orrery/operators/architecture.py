"""Architecture as one table of facts, of which elements, relations and views are projections; runtime stages of images."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Views by the relations they show; a view without any is there, but not available.
VIEWS = {
    "system-context": ("uses", "publishes"),
    "deployment": ("runs", "exposes", "built-from", "copies-from"),
    "component": ("contains", "depends-on", "calls"),
}


def facts(sources: dict[str, DataFrame]) -> DataFrame:
    """(element, kind, relation, target, evidence, sources): what ``sources`` (by name: element, kind, relation, target,
    evidence) say, each fact once with all evidence for it, sorted, and the names of who says so.

    An element alone is a fact without relation and target. The kind of an element is the first by name that any source
    gives it, the same in all its facts; rows without an element are left out.
    """
    every = reduce(DataFrame.unionByName, [df.select("element", "kind", "relation", "target", "evidence", F.lit(name).alias("source")) for name, df in sorted(sources.items())])
    every = every.filter("element IS NOT NULL")
    kinds = every.groupBy("element").agg(F.min("kind").alias("kind"))
    one = every.groupBy("element", "relation", "target").agg(F.array_sort(F.collect_set("evidence")).alias("evidence"), F.array_sort(F.collect_set("source")).alias("sources"))
    return one.join(kinds, "element").select("element", "kind", "relation", "target", "evidence", "sources")


def elements(of: DataFrame) -> DataFrame:
    """(element, kind, sources, relations): every element of ``facts``; what is only pointed at is external."""
    # each fact once, as a row for either end: what has none of its own is external
    end = lambda element, kind, own, r: F.struct(element.alias("element"), kind.alias("kind"), own.alias("own"), r.alias("r"))
    ends = F.array(end(F.col("element"), F.col("kind"), F.lit(True), F.col("relation").isNotNull().cast("long")), end(F.col("target"), F.lit(None).cast("string"), F.lit(False), F.lit(0).cast("long")))
    rows = of.select(F.explode(ends).alias("e"), "sources").select("e.*", "sources").filter("element IS NOT NULL")
    own = F.col("own")
    out = rows.groupBy("element").agg(F.max("own").alias("own"), F.max("kind").alias("kind"), F.collect_set(F.when(own, F.col("sources"))).alias("said"), F.collect_set(F.when(~own, F.col("sources"))).alias("pointed"), F.sum("r").alias("relations"))
    sources = F.array_sort(F.array_distinct(F.flatten(F.when(own, F.col("said")).otherwise(F.col("pointed")))))
    return out.select("element", F.when(own, F.col("kind")).otherwise("external").alias("kind"), sources.alias("sources"), "relations")


def views(of: DataFrame, shown: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(view, element, relation, target) of each view's relations; elements without relations are in no view."""
    pairs = [(view, r) for view, rs in (shown or VIEWS).items() for r in rs]
    names = of.sparkSession.createDataFrame(pairs, "view string, relation string")
    return of.filter("relation IS NOT NULL").join(F.broadcast(names), "relation").select("view", "element", "relation", "target")


def overview(of: DataFrame, shown: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(view, available, elements, relations): one row for each view, with the distinct elements at its relations' ends."""
    rows = views(of, shown)
    ends = rows.select("view", F.explode(F.array("element", "target")).alias("e")).groupBy("view").agg(F.countDistinct("e").alias("elements"))
    counts = rows.groupBy("view").agg(F.count(F.lit(1)).alias("relations")).join(ends, "view")
    names = of.sparkSession.createDataFrame([(v,) for v in (shown or VIEWS)], "view string")
    zero = F.lit(0).cast("long")
    return names.join(counts, "view", "left").select("view", F.col("relations").isNotNull().alias("available"), F.coalesce("elements", zero).alias("elements"), F.coalesce("relations", zero).alias("relations"))


def build_stages(instructions: DataFrame, targets: list[str] | None = None) -> DataFrame:
    """(path, index, name, base, role, ports, volumes, copies_from, environment, workdir, command, entrypoint) of each stage
    of ``instructions`` (path, at, instruction, argument, stage: ``docker_instructions``).

    A stage is named by its alias, else stage-n from 1. Its role is runtime if it is among ``targets``, or without any if
    it is the last one, else build. ``copies_from`` are names of stages (numbers are looked up) or of images. Of settings
    given several times the last counts; ports and volumes once, sorted. What stands before the first stage is none's.
    """
    i, arg = F.col("instruction"), F.col("argument")
    rows = instructions.filter("stage >= 0")
    alias = F.regexp_extract("argument", r"(?i)\s+AS\s+(\S+)\s*$", 1)
    heads = rows.filter(i == "FROM").select("path", "stage", F.when(alias != "", alias).otherwise(F.concat(F.lit("stage-"), (F.col("stage") + 1).cast("string"))).alias("name"), F.regexp_extract("argument", r"^(?:--\S+\s+)*(\S+)", 1).alias("base"))
    words = F.filter(F.split(F.regexp_replace(arg, r'[\[\],"]', " "), r"\s+"), lambda x: x != "")
    last = lambda what: F.max_by(F.when(i == what, arg), F.when(i == what, F.col("at"))).alias(what.lower())
    bag = lambda what, name: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(i == what, words))))).alias(name)
    pair = F.when(arg.rlike(r"^\w+="), F.regexp_extract_all(arg, F.lit(r"(\w+=(?:\"[^\"]*\"|\S*))"), F.lit(1))).otherwise(F.array(F.regexp_replace(arg, r"^(\w+)\s+", "$1=")))
    env = rows.filter(i == "ENV").select("path", "stage", "at", F.posexplode(pair).alias("k", "p"))
    env = env.select("path", "stage", F.struct("at", "k").alias("o"), F.substring_index("p", "=", 1).alias("n"), F.regexp_replace(F.regexp_replace("p", r"^[^=]*=", ""), '^"|"$', "").alias("v"))
    env = env.groupBy("path", "stage", "n").agg(F.max_by("v", "o").alias("v")).groupBy("path", "stage").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("n", "v")))).alias("environment"))
    copies = rows.filter(i.isin("COPY", "ADD")).select("path", "stage", F.regexp_extract("argument", r"--from=(\S+)", 1).alias("from")).filter(F.col("from") != "")
    numbered = heads.select("path", F.col("stage").cast("string").alias("from"), F.col("name").alias("at"))
    copies = copies.join(numbered, ["path", "from"], "left").groupBy("path", "stage").agg(F.array_sort(F.collect_set(F.coalesce("at", "from"))).alias("copies_from"))
    body = rows.groupBy("path", "stage").agg(bag("EXPOSE", "ports"), bag("VOLUME", "volumes"), last("WORKDIR"), last("CMD"), last("ENTRYPOINT"))
    out = heads.join(body, ["path", "stage"]).join(env, ["path", "stage"], "left").join(copies, ["path", "stage"], "left")
    final = F.col("stage") == F.max("stage").over(Window.partitionBy("path"))
    role = F.when(F.col("name").isin(targets), "runtime").otherwise("build") if targets else F.when(final, "runtime").otherwise("build")
    none = F.array().cast("array<string>")
    return out.select(
        "path", F.col("stage").cast("int").alias("index"), "name", "base", role.alias("role"), "ports", "volumes", F.coalesce("copies_from", none).alias("copies_from"),
        F.coalesce("environment", F.create_map().cast("map<string,string>")).alias("environment"), "workdir", F.col("cmd").alias("command"), "entrypoint",
    )


def stage_facts(stages: DataFrame) -> DataFrame:
    """The stages as a source of ``facts``: what they are built from, copy from and expose."""
    me = F.concat_ws("#", "path", "name")
    of = lambda relation, target: stages.select(me.alias("element"), F.concat("role", F.lit("-stage")).alias("kind"), F.lit(relation).alias("relation"), target.alias("target"), F.col("path").alias("evidence"))
    return of("built-from", F.col("base")).unionByName(of("copies-from", F.explode("copies_from"))).unionByName(of("exposes", F.explode("ports")))
