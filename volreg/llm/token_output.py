"""Token ids in a binary file format: frequency ranks in byte-aligned variable-length coding.

Format. A folder of Parquet files as containers, in ascending doc_id order over shards
(``shard``: number of the task that wrote it, ascending). A row is a block of whole
documents, about 65,536 ids: ``first`` (ids of the shard before it), ``doc_ids``,
``lengths`` (ids of each document), ``control`` and ``data``. The id of frequency rank r
is coded as r, little-endian, in 1 to 4 bytes in ``data``; ``control`` holds the byte
counts less one, two bits each, four to a byte, lowest bits first. A second table holds
the ids by rank. Blocks decode by lookups in tables of 256 control bytes.

Cases. A null or empty text has the end id alone. Rows with equal doc_id are written one
after another. A null doc_id comes first and is read back as null. A table without rows
gives none. A very long text makes a block of its own size. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, on_workers, record, stored, with_text
from .tokens import encoder

END_ID = 0
BLOCK_IDS = 1 << 16

# decoding tables: for each control byte the widths, offsets and total of its four ids
_WIDTH = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
_OFFSET = np.cumsum(_WIDTH, axis=1) - _WIDTH
_TOTAL = _WIDTH.sum(axis=1)


def code(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    v = values.astype("<u4")
    width = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < width[:, None]]
    pairs = np.zeros((len(v) + 3) // 4 * 4, np.uint8)
    pairs[: len(v)] = width - 1
    pairs = pairs.reshape(-1, 4)
    return (pairs[:, 0] | pairs[:, 1] << 2 | pairs[:, 2] << 4 | pairs[:, 3] << 6).tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of control and data bytes."""
    c = np.frombuffer(control, np.uint8)
    total = _TOTAL[c]
    at = ((np.cumsum(total) - total)[:, None] + _OFFSET[c]).ravel()[:n]
    width = _WIDTH[c].ravel()[:n]
    d = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    out = np.zeros(n, np.uint32)
    for k in range(4):
        out |= np.where(k < width, d[np.minimum(at + k, len(d) - 1)] << np.uint32(8 * k), np.uint32(0))
    return out


def _kind(vocabulary: int) -> type:
    return np.uint16 if vocabulary <= 1 << 16 else np.uint32


def _tokenized(batch: pa.RecordBatch, path: str, end_id: int, kind: type) -> pa.RecordBatch:
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    ids = [np.append(x, np.uint32(end_id)) for x in encoder(path)(batch.column("text").to_pylist())]
    packed = [pack(x.astype(kind).tobytes()) for x in ids]
    return record(doc_id=batch.column("doc_id"), n=pa.array(map(len, ids), pa.int64()), packed=pa.array(packed, pa.binary()))


def _unpacked(batch: pa.RecordBatch, kind: type) -> list[np.ndarray]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return [np.frombuffer(unpack(x), kind) for x in batch.column("packed").to_pylist()]


class TokenFiles(NamedTuple):
    blocks: DataFrame
    ranks: DataFrame  # (rank, id): at most the vocabulary's size


def write_tokens(docs: DataFrame, path: str, end_id: int = END_ID) -> TokenFiles:
    """Encode every text with the vocabulary at ``path`` and write the token files to the shared folder."""
    vocabulary = encoder(path).tokenizer.get_vocab_size()
    kind = _kind(max(vocabulary, end_id + 1))
    size = max(vocabulary, end_id + 1)
    key = docs.schema["doc_id"].dataType.simpleString()
    tokens = stored(map_batches(with_text(docs, "doc_id"), partial(_tokenized, path=path, end_id=end_id, kind=kind), f"doc_id {key}, n long, packed binary", keeps=True), "tokens")
    spark = docs.sparkSession
    on_workers(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for ids in _unpacked(batch, kind):
                total += np.bincount(ids, minlength=size)
        used = np.flatnonzero(total)
        yield record(id=used.astype(np.int32), count=total[used])

    counts = tokens.select("packed").mapInArrow(count, "id int, count long").groupBy("id").agg(F.sum("count").alias("count"))
    # one row for each id of the vocabulary at most, so the driver can order them
    by_rank = [x.id for x in counts.orderBy(F.desc("count"), "id").collect()]
    ranks = spark.createDataFrame(list(enumerate(by_rank)), "rank int, id int")
    rank_of = np.zeros(size, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    rank_of = spark.sparkContext.broadcast(rank_of)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, first, held, doc_ids, lengths = TaskContext.get().partitionId(), 0, [], [], []

        def block() -> pa.RecordBatch:
            values = rank_of.value[np.concatenate(held)]
            control, data = code(values)
            return record(shard=pa.array([shard], pa.int32()), first=pa.array([first], pa.int64()), doc_ids=pa.array([doc_ids], pa.list_(key_type)), lengths=pa.array([lengths], pa.list_(pa.int64())), control=pa.array([control], pa.binary()), data=pa.array([data], pa.binary()))

        for batch in batches:
            key_type = batch.column("doc_id").type
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), _unpacked(batch, kind), strict=True):
                if held and sum(lengths) + len(ids) > BLOCK_IDS:
                    yield block()
                    first, held, doc_ids, lengths = first + sum(lengths), [], [], []
                held.append(ids)
                doc_ids.append(doc_id)
                lengths.append(len(ids))
        if held:
            yield block()

    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "n", "packed")
    return TokenFiles(stored(ordered.mapInArrow(blocks, f"shard int, first long, doc_ids array<{key}>, lengths array<long>, control binary, data binary"), "token-blocks"), ranks)


def read_tokens(files: TokenFiles) -> DataFrame:
    """One row for each document: where its ids start, how many, and their bytes (little-endian, 32 bits)."""
    return _read(files, lambda ids: {"ids": pa.array([x.tobytes() for x in ids], pa.binary())}, "ids binary")


def _read(files: TokenFiles, columns, schema: str) -> DataFrame:
    spark = files.blocks.sparkSession
    on_workers(spark)
    by_rank = spark.sparkContext.broadcast(np.array([x.id for x in files.ranks.orderBy("rank").collect()] or [0], np.uint32))
    # as many rows as tasks wrote: their running total is small whatever the corpus
    sizes = files.blocks.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b)).alias("ids"))
    before = sizes.select("shard", F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    key = files.blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                lengths = np.array(block["lengths"], np.int64)
                ends = np.cumsum(lengths)
                ids = by_rank.value[decode(block["control"], block["data"], int(ends[-1]))].astype("<u4")
                starts = ends - lengths
                yield record(doc_id=pa.array(block["doc_ids"], batch.column("doc_ids").type.value_type), start=pa.array(block["before"] + block["first"] + starts), n_tokens=pa.array(lengths), **columns([ids[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]))

    return files.blocks.join(F.broadcast(before), "shard").mapInArrow(rows, f"doc_id {key}, start long, n_tokens long, {schema}")


def op3_token_output(spark, sf_dir):
    import public_tokenizers

    files = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return _read(files, lambda ids: {"ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())}, "ids_crc32 long")
