"""What operators share with the cluster: the folder for stored tables, and the library on workers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this library wherever the driver started."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Rows from which on a stored table is never broadcast, and the size of its files below which it surely has fewer or small ones.
MOST_ROWS, LEAST_BYTES = 50_000, 1 << 15


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder.

    Files tell little of how large rows are in memory, so a table of many rows says itself that it is large.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return large(out) if _many_rows(out, path) else out


def _many_rows(df: DataFrame, path: str) -> bool:
    """Whether a stored table has more than ``MOST_ROWS``; the files' ends tell how many, no row is read."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return size > LEAST_BYTES and df.count() > MOST_ROWS


def spread(df: DataFrame, *keys: str, fine: bool = True) -> DataFrame:
    """``df`` in several tasks for each core, whatever few files or row groups it is read from: for rows that cost much each, or, not so ``fine``, that become many."""
    spark = df.sparkSession
    tasks = 4 * spark.sparkContext.defaultParallelism
    return df.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))) if fine else tasks, *keys)


def large(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that grows with the points: shuffled, as a stored table's files are far smaller than its rows, and the driver would build a broadcast of them."""
    return df.hint("merge")
