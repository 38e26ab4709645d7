"""Tables of fixed length, counts or marks, put together over all tasks and broadcast.

A table has ``2 ** BITS`` counters or ``2 ** MARK_BITS`` marks whatever the input's size (8 MB
as broadcast each), so its size bound is proven. Keys that share a place share its count or
mark: users of a table stay right with any and only get slower where many keys share one.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .common import drop_kept, on_workers, split_batch
from .wordkernel import mix

BITS = 22
MARK_BITS = 26
_CHUNK = 1 << 16
_MARKS = 1 << 20  # marks of a chunk
MASK = np.uint64((1 << BITS) - 1)


def slot(keys: np.ndarray) -> np.ndarray:
    return (keys & MASK).astype(np.int64)


def id_keys(ids: np.ndarray) -> np.ndarray:
    return mix(np.asarray(ids, np.int64).view(np.uint64))


def counted(df: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray]) -> Broadcast:
    """A broadcast array of levels, 16 for each doubling of a counter, from the keys of all rows."""
    spark = df.sparkSession
    on_workers(spark)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        counts = np.zeros(1 << BITS, np.uint32)
        for batch in batches:
            for part in split_batch(batch):
                found, n = np.unique(slot(keys(part)), return_counts=True)
                counts[found] += n.astype(np.uint32)
        for i in range(0, len(counts), _CHUNK):
            if (chunk := counts[i : i + _CHUNK]).any():
                # few counters of one task pass 255, so most chunks shrink to one byte a counter
                kind = np.uint8 if chunk.max() < 256 else np.uint32
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([i // _CHUNK], pa.int32()), "wide": pa.array([kind is np.uint32]), "counts": pa.array([zlib.compress(chunk.astype(kind).tobytes(), 1)], pa.binary())})

    def total(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(_CHUNK, np.uint64)
        for part in parts:
            for wide, packed in zip(part["wide"], part["counts"], strict=True):
                counts += np.frombuffer(zlib.decompress(packed), np.uint32 if wide else np.uint8)
        levels = np.round(16 * np.log2(counts + 1.0)).astype(np.uint16)
        yield pd.DataFrame({"chunk": [key[0]], "levels": [zlib.compress(levels.tobytes(), 1)]})

    sums = df.mapInArrow(partial, "chunk int, wide boolean, counts binary").groupBy("chunk").applyInPandas(total, "chunk int, levels binary")
    levels = np.zeros(1 << BITS, np.uint16)
    for chunk, packed in sums.collect():  # 2 ** BITS counters at most
        levels[chunk * _CHUNK : (chunk + 1) * _CHUNK] = np.frombuffer(zlib.decompress(packed), np.uint16)
    return spark.sparkContext.broadcast(levels)


def mark_slot(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - MARK_BITS)).astype(np.int64)


def is_marked(marks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = mark_slot(keys)
    return (marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def marked(df: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray]) -> Broadcast:
    """A broadcast array of bits, set for the keys of all rows; read it by ``is_marked``."""
    spark = df.sparkSession
    on_workers(spark)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        marks = np.zeros(1 << MARK_BITS, bool)
        for batch in batches:
            marks[mark_slot(keys(batch))] = True
        for i in range(0, len(marks), _MARKS):
            if (chunk := marks[i : i + _MARKS]).any():
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([i // _MARKS], pa.int32()), "marks": pa.array([zlib.compress(np.packbits(chunk).tobytes(), 1)], pa.binary())})

    def either(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks = np.zeros(_MARKS // 8, np.uint8)
        for part in parts:
            for packed in part["marks"]:
                marks |= np.frombuffer(zlib.decompress(packed), np.uint8)
        yield pd.DataFrame({"chunk": [key[0]], "marks": [zlib.compress(marks.tobytes(), 1)]})

    whole = df.mapInArrow(partial, "chunk int, marks binary").groupBy("chunk").applyInPandas(either, "chunk int, marks binary")
    out = np.zeros(1 << MARK_BITS - 3, np.uint8)
    for chunk, packed in whole.collect():  # 2 ** MARK_BITS bits at most
        out[chunk * (_MARKS // 8) : (chunk + 1) * (_MARKS // 8)] = np.frombuffer(zlib.decompress(packed), np.uint8)
    return spark.sparkContext.broadcast(out)
