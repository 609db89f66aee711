"""Intermediate tables in the folder that all executors share.

A saved table cuts the lineage: a lost executor costs a reread, not the whole
computation.  The folder is the session's ``spark.checkpoint.dir``; where that
is unset, as in tests on one machine, a temporary folder is made.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that deletes shuffle files at the end of an execution.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_root: str | None = None
_saved: list[str] = []


def root(spark: SparkSession) -> str:
    global _local_root
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    _local_root = _local_root or tempfile.mkdtemp(prefix="tidelake-")
    return f"file://{_local_root}"


def new_path(spark: SparkSession, name: str, swept: bool = True) -> str:
    path = f"{root(spark)}/tidelake/{name}-{uuid.uuid4().hex}"
    if swept:
        _saved.append(path)
    return path


def save(df: DataFrame, name: str, swept: bool = True) -> DataFrame:
    """Write the rows as Parquet to the shared folder and return a frame that reads them.

    What is not `swept` stays until it is dropped.  The shuffle files of the
    write go when it ends: the saved rows stand for them.
    """
    spark = df.sparkSession
    path = new_path(spark, name, swept)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    saved = spark.read.schema(df.schema).parquet(path)
    saved._scratch_path = path
    return saved


def drop(*saved: DataFrame) -> None:
    """Delete saved tables that nothing reads any more."""
    for df in saved:
        _delete(df.sparkSession, df._scratch_path)
        if df._scratch_path in _saved:
            _saved.remove(df._scratch_path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a table that is read in fewer parts than there are cores, dealt to all cores; others as they are."""
    if rows._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan":  # shuffled already
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows._jdf.rdd().getNumPartitions() >= cores else rows.repartition(cores)


def mark() -> int:
    """A point in the order of saving, for `sweep`."""
    return len(_saved)


def sweep(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables saved since a mark; frames that still read them stop working."""
    while len(_saved) > since:
        _delete(spark, _saved.pop())


@atexit.register
def _at_exit() -> None:
    """What results still read goes when the driver ends, where its session is still there."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):  # the driver's JVM may be gone already
            sweep(spark)
