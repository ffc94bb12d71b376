"""Runs by cohort: rates with what they leave out, lift over a baseline, and a matrix of tasks and cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cohorts that a matrix has columns for.
COLUMNS = 200


def cohort_stats(runs: DataFrame, baseline: str) -> DataFrame:
    """(cohort, runs, judged, unjudged, passes, rate, tokens, without_tokens, lift, token_ratio) of runs (cohort, passed,
    tokens).

    Runs without a verdict (null) don't count in the rate; ``tokens`` is the mean of passed runs that say theirs. Lift and
    ratio are over the baseline's, null where that is null or zero.
    """
    good = F.col("passed") & F.col("tokens").isNotNull()
    by = runs.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("runs"), F.count("passed").alias("judged"), F.count(F.when(F.col("passed").isNull(), 1)).alias("unjudged"), F.count(F.when(F.col("passed"), 1)).alias("passes"),
        F.avg(F.col("passed").cast("int")).alias("rate"), F.avg(F.when(good, F.col("tokens"))).alias("tokens"), F.count(F.when(F.col("passed") & F.col("tokens").isNull(), 1)).alias("without_tokens"),
    )
    base = by.filter(F.col("cohort") == baseline).select(F.col("rate").alias("_rate"), F.col("tokens").alias("_tokens"))  # one row or none
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return by.join(F.broadcast(base), how="left").withColumn("lift", over("rate", "_rate")).withColumn("token_ratio", over("tokens", "_tokens")).drop("_rate", "_tokens")


def cohort_matrix(runs: DataFrame, most: int = COLUMNS) -> DataFrame:
    """(task, a column for each cohort that there is): passes over judged runs as ``p/n``, null where a task has none.

    Cohorts are looked up first; more than ``most`` of them are refused, since they are columns.
    """
    names = sorted(r[0] for r in runs.select("cohort").filter("cohort IS NOT NULL").distinct().limit(most + 1).collect())
    if len(names) > most:
        raise ValueError(f"over {most} cohorts don't fit as columns")
    judged = runs.filter("passed IS NOT NULL")
    cells = judged.groupBy("task", "cohort").agg(F.concat_ws("/", F.sum(F.col("passed").cast("int")).cast("string"), F.count(F.lit(1)).cast("string")).alias("cell"))
    return runs.select("task").distinct().join(cells.groupBy("task").pivot("cohort", names).agg(F.max("cell")), "task", "left")
