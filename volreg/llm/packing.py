"""Harmonic packing of token ids into sequences of fixed capacity.

A document's ids are cut into pieces that lie just under a reciprocal of the capacity:
a whole sequence while they last, then the next smaller reciprocal unless what is left
already fills its own class but for a few ids. A piece of class k has at most
``capacity // k`` ids, and a bin of class k takes exactly k pieces. The last class has all
shorter pieces and fills its bins by length, until the next piece does not fit. Each task
fills the bins of its own pieces without regard to others. Pieces of bins left open (fewer
than k for each class and task, of the last class a capacity's ids) are dealt to a
``POOL``-th of as many tasks, which fill bins by class again, and so on until one task has
what is left of ``POOL`` tasks at most; it packs the rest first-fit by falling length.

Cases. A null or empty text has the end id alone. Rows with equal doc_id are packed
each for itself. A null doc_id is handed on. A table without rows gives none. A very long
text gives many whole sequences. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import on_workers, record, split_batch, stored, with_text
from .tokens import encoder

CAPACITY = 2048
END_ID = 1
#: Pieces of at most ``capacity // LAST_CLASS`` ids share the last class.
LAST_CLASS = 64
#: A piece is cut unless it fills all but one part in so many of its class's share.
TIGHT = 64
#: Tasks whose open bins meet in one task of the next round.
POOL = 64

_PIECE = "doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long, class int, sequence_id long, offset long, worker long"


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """``(length, class)`` of the pieces of n ids, in order."""
    out = [(capacity, 1)] * (n // capacity)
    left = n % capacity
    while left:
        k = min(capacity // left, LAST_CLASS)
        share = capacity // k
        if k < LAST_CLASS and (share - left) * TIGHT > share:
            k, share = k + 1, capacity // (k + 1)
        piece = min(left, share)
        out.append((piece, k))
        left -= piece
    return out


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row for each piece: its document, its ids' place there, its sequence and its place in that.

    ``with_ids`` adds the ids themselves (little-endian, 32 bits) as ``ids``.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = _PIECE.format(key=key) + ", ids binary" * with_ids
    on_workers(docs.sparkSession)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = TaskContext.get().partitionId()
        open_bins: dict[int, list[list]] = {}
        filled, kind, used = 0, None, 0  # used: ids in the last class's open bin

        def rows(pieces: list[list]) -> pa.RecordBatch:
            columns = list(zip(*pieces, strict=True))
            types = [kind, *[pa.int64()] * 4, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "sequence_id", "offset", "worker", "ids"]
            return record(**{n: pa.array(c, t) for n, c, t in zip(names, columns, types[: len(columns)], strict=False)})

        def closed(k: int) -> list[list]:
            nonlocal filled
            offset = 0
            for piece in open_bins[k]:
                piece[6:8] = worker << 32 | filled, offset
                offset += piece[2]
            filled += 1
            return open_bins.pop(k)

        for whole in batches:
            for batch in split_batch(whole):
                kind, done = batch.column("doc_id").type, []
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder(path)(batch.column("text").to_pylist()), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    start = 0
                    for length, k in cuts(len(ids), capacity):
                        own = ids[start : start + length].tobytes()
                        if k == LAST_CLASS and used + length > capacity:
                            done += closed(k)
                            used = 0
                        bin_ = open_bins.setdefault(k, [])
                        bin_.append([doc_id, start, length, zlib.crc32(own), len(ids), k, None, None, worker, *([own] if with_ids else [])])
                        start += length
                        if k == LAST_CLASS:
                            used += length
                        elif len(bin_) == k:
                            done += closed(k)
                if done:
                    yield rows(done)
        if rest := [piece for bin_ in open_bins.values() for piece in bin_]:
            yield rows(rest)

    pieces = stored(with_text(docs, "doc_id").mapInArrow(fill, schema), "pieces")
    columns, out = pieces.columns, pieces.where("sequence_id is not null")
    rest, round_ = pieces.where("sequence_id is null"), 0
    while True:
        # a pool has fewer than LAST_CLASS ** 2 / 2 pieces of each of its tasks
        round_ += 1
        tasks = rest.agg(F.max("worker")).first()[0]
        last = tasks is None or tasks < POOL
        rest = stored(rest.withColumn("worker", F.floor(F.col("worker") / POOL)).groupBy("worker").applyInArrow(_round(capacity, round_, last), schema), "refilled").select(columns)
        out = out.union(rest.where("sequence_id is not null"))
        if last:
            return out
        rest = rest.where("sequence_id is null")


def _round(capacity: int, round_: int, last: bool):
    def again(pool: pa.Table) -> pa.Table:
        return refill(pool, capacity, round_, last)

    return again


def refill(pool: pa.Table, capacity: int, round_: int, last: bool) -> pa.Table:
    """The pieces of some tasks' open bins in bins by class; what fills none goes first-fit if this is the last round, or stays open."""
    keys = [(c, "ascending") for c in ("class", "doc_id", "start", "ids_crc32")]
    pool = pool.take(pc.sort_indices(pool, keys, null_placement="at_start")).combine_chunks()
    length, kind = pool["length"].to_numpy(), pool["class"].to_numpy()
    number, offset = np.full(len(pool), -1, np.int64), np.zeros(len(pool), np.int64)
    filled = 0
    for k in np.unique(kind):
        own, at, used = np.flatnonzero(kind == k), 0, 0
        for i, row in enumerate(own):
            # a bin of class k closes at k pieces, of the last class when the next does not fit
            if (used + length[row] > capacity) if k == LAST_CLASS else (i - at == k):
                number[own[at:i]], at, used, filled = filled, i, 0, filled + 1
            offset[row] = used
            used += length[row]
        if k != LAST_CLASS and len(own) - at == k:
            number[own[at:]], filled = filled, filled + 1
    if last:
        room: list[int] = []
        left = np.flatnonzero(number < 0)
        for row in left[np.argsort(-length[left], kind="stable")]:
            n = next((i for i, used in enumerate(room) if used + length[row] <= capacity), len(room))
            if n == len(room):
                room.append(0)
            number[row], offset[row] = filled + n, room[n]
            room[n] += length[row]
    ids = pa.array(number + (round_ << 58) + (pool["worker"].to_numpy() << 32), pa.int64(), mask=number < 0)
    for name, values in (("sequence_id", ids), ("offset", pa.array(offset))):
        pool = pool.set_column(pool.schema.get_field_index(name), name, values)
    return pool


def sequences(pieces: DataFrame) -> DataFrame:
    """``(sequence_id, ids, doc_ids)`` of pieces packed ``with_ids``: each has the capacity's ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    joined = pieces.groupBy("sequence_id").agg(parts.alias("parts"))
    ids = F.aggregate("parts", F.lit(b"").cast("binary"), lambda all_, x: F.concat(all_, x["ids"]))
    return joined.select("sequence_id", ids.alias("ids"), F.transform("parts", lambda x: x["doc_id"]).alias("doc_ids"))


def op5_packing(spark, sf_dir):
    import public_tokenizers

    pieces = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.drop("worker")
