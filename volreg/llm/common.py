"""What the text operators share: reading tables, shared folders, Arrow batches."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a Python worker keeps between tasks, by functions that drop it. Workers serve one
#: operator after another, so a kernel that does not use what is kept drops it.
KEPT: list[Callable[[], None]] = []

#: Bytes of text that a kernel works on at once: its arrays are a few times as large.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver started."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
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


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, not the work before.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    # the schema is known, so no file needs to be opened for it (and none need exist)
    return spark.read.schema(df.schema).parquet(path)


def with_text(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and the whole text; a null text counts as empty."""
    return docs.select(*columns, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def drop_kept() -> None:
    for drop in KEPT:
        drop()


def map_batches(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text", keeps: bool = False) -> DataFrame:
    """Apply ``kernel`` to parts of each Arrow batch with about ``CHUNK_BYTES`` in ``column``.

    No shuffle, no state between batches but what a kernel that ``keeps`` leaves in the worker.
    """
    on_workers(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            drop_kept()
        for batch in batches:
            for part in split_batch(batch, column):
                out = kernel(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def split_batch(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about ``most`` bytes of text, or one row if its text is longer."""
    if column not in batch.schema.names:
        yield batch
        return
    start, size = 0, 0
    values = batch.column(column)
    lengths = pc.binary_length(values.fill_null("" if pa.types.is_string(values.type) else b"")).to_pylist()
    for row, n in enumerate(lengths):
        if size and size + n > most:
            yield batch.slice(start, row - start)
            start, size = row, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def record(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))
