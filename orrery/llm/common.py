"""Shared pieces: durable materialisation, skew-safe lookups, distributed prefix sums."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, wherever a contract counts or shingles words.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a private one only where none is configured (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="orrery-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/orrery/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._orrery_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and that no later plan reads."""
    path = getattr(df, "_orrery_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound the Arrow batches sent to Python: texts are long, and the default of 10,000 rows a batch is not."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: At most this many keys can each own more than 1/HOT of all rows, so a table of hot keys has a proven size bound.
HOT = 128


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, total: int | None = None) -> DataFrame:
    """Inner join on ``key``, unique in ``right``, whose ``weight`` is the number of ``left`` rows with that key
    (``total`` of them, if that is known already).

    Keys owning over 1/HOT of the rows (fewer than HOT of them, hence a bounded broadcast) never meet in one task:
    their ``left`` rows stay where they are. All other keys are shuffled.
    """
    if total is None:
        total = right.agg(F.sum(weight)).first()[0] or 0
    limit = max(total // HOT, 1000)
    hot = right.filter(F.col(weight) > limit).drop(weight)
    cold = right.filter(F.col(weight) <= limit).drop(weight)
    if total <= limit:
        return left.join(right.drop(weight), key)
    near = left.join(F.broadcast(hot), key)
    far = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return near.unionByName(far)


#: Rows of a partition of ``prefix_sums``, about, where spark.sql.shuffle.partitions of them would be larger.
DEALT = 4_000_000


def prefix_sums(df: DataFrame, order: list[str], sums: dict[str, str], group: str | None = None) -> DataFrame:
    """Exclusive running sums in the order of ``order``, without gathering rows in one task.

    ``sums`` maps new column -> summed column; with ``group`` (non-null, first of ``order``) they restart at each of
    its values. Rows are dealt by range of ``order`` and written, so every later read sees the same partitions; each
    partition keeps its own running sums; the totals of the partitions are summed and added. Only the group that a
    partition starts in the middle of needs an offset, so no more offsets than partitions are broadcast.
    Rows that tie in ``order`` are put in an arbitrary order, which holds throughout the result.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // DEALT))
    order = [*order, "_tie"]
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order)
    dealt = materialize(dealt.withColumn("_part", F.spark_partition_id()), "dealt")
    keys = ["_part"] + ([group] if group else [])
    totals = dealt.groupBy(*keys).agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums.values())])
    before = (Window.partitionBy(group) if group else Window).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, *[F.sum(f"_t{i}").over(before).alias(f"_o{i}") for i in range(len(sums))]).filter("_o0 IS NOT NULL")
    w = Window.partitionBy(*keys).orderBy(*order[1 if group else 0 :]).rowsBetween(Window.unboundedPreceding, -1)
    local = [F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_l{i}") for i, c in enumerate(sums.values())]
    joined = dealt.select("*", *local).join(F.broadcast(offsets), keys, "left")
    return joined.select(*df.columns, *[(F.col(f"_l{i}") + F.coalesce(f"_o{i}", F.lit(0))).alias(out) for i, out in enumerate(sums)])


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A non-null key of a row, the same for repeated rows only; smaller ids come first, null ids last."""
    return F.struct(F.col(id_col).isNull().alias("n"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("i"), F.xxhash64(F.col(text_col)).alias("h"))


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever columns came along."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
