"""Intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder on a cluster.  It is set to a local
folder only where the session has none, as in tests.  A table written here
survives the loss of any executor and cuts the lineage of what reads it.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        own = spark.sparkContext.getCheckpointDir()
        if own:
            return own
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="neartide-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/neartide/{tag}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # the shuffle files of a table that is written are not read again
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _written.append((spark, path))
    found = spark.read.schema(df.schema).parquet(path)
    found._table = path
    return found


def release(df: DataFrame) -> None:
    """Deletes the table that ``materialize`` returned as ``df``; what still reads it fails."""
    _delete(df.sparkSession, df._table)
    _written.remove((df.sparkSession, df._table))


def numbered(df: DataFrame, column: str) -> DataFrame:
    """Writes ``df`` with a number of its own for each row, in ``column``, so that rows can be decided on whatever their keys are."""
    return materialize(df.withColumn(column, F.monotonically_increasing_id()), "rows")


def discard() -> None:
    """Deletes the tables written so far; results that still read them fail."""
    while _written:
        _delete(*_written.pop())


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _at_exit() -> None:
    try:
        discard()
    except Exception:  # the JVM may have ended already
        pass
