"""Storage that all executors share: checkpoints that cut lineage, and tables that are made once and read by later queries."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a private one only where none is configured, on a local master (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="orrery-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df`` in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str = "rounds") -> DataFrame:
    """``df`` written as a table in the shared folder and read back, with no more files than a shuffle has partitions.

    Loops use it where a checkpoint would do: what a checkpoint knows about its columns (their constraints) grows from round
    to round with conditional expressions, until planning takes longer than the work. Like a checkpoint's, its files stay
    until the folder is emptied, as a returned plan may still read them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/orrery/{name}-{uuid.uuid4().hex}"
    df.coalesce(int(spark.conf.get("spark.sql.shuffle.partitions"))).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of ``path``, its path)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def stamp(spark: SparkSession, path: str) -> tuple:
    """(file, size, time of change) of every file at or below ``path``."""
    fs, at = file_system(spark, path)
    found, files = [], fs.listFiles(at, True)
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


_STORED: dict[tuple, tuple[tuple, str]] = {}


def stored(spark: SparkSession, name: str, inputs: list[str], build: Callable[[str], None]) -> str:
    """The folder of what ``build`` wrote there from ``inputs``: made once by this application and used again as long as
    the inputs' files have the same sizes and times; what changed inputs left behind is deleted."""
    key, now = (spark.sparkContext.applicationId, name, tuple(inputs)), tuple(stamp(spark, p) for p in inputs)
    seen, path = _STORED.get(key, (None, ""))
    if path:
        fs, at = file_system(spark, path)
        if seen == now and fs.exists(at):
            return path
        fs.delete(at, True)
    path = f"{shared_dir(spark)}/orrery/{name}-{uuid.uuid4().hex}"
    build(path)
    _STORED[key] = (now, path)
    return path
