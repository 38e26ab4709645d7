"""What the vector operators share: integer vectors, blocks of them, searches by rounds.

Cases. A null vector, or one with a null or non-finite component, is left out, and so is
one whose integers' squares add up to 2^60 or more, as no long holds its scores for sure.
Vectors of different lengths are compared as if zeros followed the shorter one. Each row
is by itself, also where vec_ids repeat.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_kept, on_workers, record, stored

#: Rows of a block of candidates, and queries of a block that meets it.
SIDE = 4096
QUERIES = 1024
#: A round of a search takes so many times the blocks of those before it. What one round
#: finds bounds the next: a query then meets about RATIO times its k rows that pass.
RATIO = 16
#: Blocks of queries are sent to so many groups of candidates at most, and so many blocks
#: of queries, or few more, are held where a group meets them.
GROUPS = 256
HELD = 64
#: Pairs are compacted into lists once so small a share of them is left; above, whole
#: matrix products cost less than gathering.
SPARSE = 1 / 32
NONE = np.iinfo(np.int64).min
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def integer_vectors(df: DataFrame, scale: int, *columns: Column) -> DataFrame:
    """``columns`` and ``v``, the floors of ``scale`` times the components of ``embedding``."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < 2.0**30))
    length = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    rows = df.where(F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = rows.select(*columns, F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    return rows.where(length(F.col("v")) < 2.0**60)


def matrix(lists: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Lists of longs as rows of a matrix, zeros after the shorter ones."""
    flat, at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    sizes = np.diff(at)
    width = int(sizes.max(initial=0)) if width is None else width
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def blocks(rows: DataFrame, laid_out: Callable[[np.ndarray], tuple[int, bytes]]) -> DataFrame:
    """Stored blocks of at most ``SIDE`` rows ``(vec_id, label, asked, v)``, by label within a task's rows.

    ``v`` is what ``laid_out`` makes of a block's matrix of dimensions by rows, with a
    number ``kind`` to read it by. A row's number is its block's plus its place.
    """
    on_workers(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        number, waiting, n = TaskContext.get().partitionId() << 36, [], 0
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            while n >= 4 * SIDE:
                whole = pa.Table.from_batches(waiting).combine_chunks().sort_by("label")
                yield from (cut(whole.slice(i, SIDE), number + i) for i in range(0, 4 * SIDE, SIDE))
                number, n = number + 4 * SIDE, n - 4 * SIDE
                waiting = whole.slice(4 * SIDE).to_batches()
        if n:
            whole = pa.Table.from_batches(waiting).combine_chunks().sort_by("label")
            yield from (cut(whole.slice(i, SIDE), number + i) for i in range(0, n, SIDE))

    def cut(part: pa.Table, number: int) -> pa.RecordBatch:
        part = part.combine_chunks().to_batches()[0]
        v = matrix(part.column("v"))
        kind, laid = laid_out(v.T.copy())
        plain = lambda c, t: part.column(c).to_numpy(zero_copy_only=False).astype(t).tobytes()
        return record(block=pa.array([number]), n=pa.array([len(v)], pa.int32()), width=pa.array([v.shape[1]], pa.int32()), kind=pa.array([kind], pa.int32()), ids=pa.array([plain("vec_id", np.int64)], pa.binary()), labels=pa.array([plain("label", np.int64)], pa.binary()), asked=pa.array([plain("asked", bool)], pa.binary()), v=pa.array([laid], pa.binary()))

    return stored(rows.mapInArrow(run, "block long, n int, width int, kind int, ids binary, labels binary, asked binary, v binary"), "vectors")


def asked(found: DataFrame, read: Callable[[int, int, int, bytes], np.ndarray]) -> DataFrame:
    """Stored rows ``(row, id, label, q)`` of what is asked for in blocks; ``q`` holds longs."""
    on_workers(found.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                at = np.flatnonzero(np.frombuffer(b["asked"], bool))
                v = read(b["kind"], b["width"], b["n"], b["v"])[:, at].T
                yield record(row=pa.array(b["block"] + at), id=pa.array(np.frombuffer(b["ids"], np.int64)[at]), label=pa.array(np.frombuffer(b["labels"], np.int64)[at]), q=pa.array([x.tobytes() for x in v], pa.binary()))

    with small_batches(found.sparkSession):
        return stored(found.mapInArrow(run, "row long, id long, label long, q binary"), "asked")


def query_blocks(rows: DataFrame, lists: list[str]) -> DataFrame:
    """Blocks of at most ``QUERIES`` of ``rows``; ``lists`` names their columns with arrays of longs."""
    on_workers(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, QUERIES):
                part = batch.slice(i, QUERIES)
                values = [np.frombuffer(x, np.int64) for x in part.column("q").to_pylist()]
                width = max(map(len, values))
                q = np.zeros((len(values), width), np.int64)
                for at, x in enumerate(values):
                    q[at, : len(x)] = x
                packed = {c: part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("row", "label")} | {"q": q} | {c: matrix(part.column(c)) for c in lists}
                yield record(**{f"q_{c}": pa.array([x.tobytes()], pa.binary()) for c, x in packed.items()}, queries=pa.array([len(q)], pa.int32()))

    return rows.mapInArrow(run, ", ".join(f"q_{c} binary" for c in ("row", "label", "q", *lists)) + ", queries int")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 16) -> Iterator[None]:
    """Batches of a few rows for Python, where a row is a block."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, rows)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def searched(candidates: DataFrame, asks: DataFrame, queries: Callable[[DataFrame | None], DataFrame], kernel: Callable[[dict], pa.RecordBatch], schema: str, best: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The best rows for all queries over all blocks of candidates, stored; ``asks`` are what ``queries`` adds bounds to.

    Each round sends the blocks of queries, with the bounds that the rounds before found, to
    RATIO times as many candidates. Both sides are shuffled by the group of candidates and a
    share of the queries, so no task and no broadcast holds all queries or all candidates: a
    file of queries is small, but not their copies for all groups, so the join is told so.
    """
    spark, n, found, before = candidates.sparkSession, candidates.count(), None, None
    on_workers(spark)
    groups = max(1, min(n, GROUPS))
    shares = max(1, math.ceil(asks.count() / (QUERIES * HELD)))
    every = lambda of_: F.explode(F.sequence(F.lit(0), F.lit(of_ - 1)))
    h = F.xxhash64("block")
    levels = math.ceil(math.log(max(n, 1), RATIO) - 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        work = kernel()  # a task's own, so what it keeps of a block is of this search
        for batch in batches:
            for i in range(batch.num_rows):
                out = work({c: x[0] for c, x in batch.slice(i, 1).to_pydict().items()})
                if out is not None and out.num_rows:
                    yield out

    for level in range(levels, -1, -1):
        part = candidates
        if level:
            cut = part.agg(F.percentile_approx(h, 1 / RATIO**level, 10000)).first()[0]
            part = part.where(h <= cut)
        part = part if before is None else part.where(h > before)
        before = cut if level else None
        q = query_blocks(*queries(found)).withColumns({"g": every(groups), "share": F.pmod(F.xxhash64("q_row"), F.lit(shares)).cast("int")})
        part = part.withColumns({"g": F.pmod(F.xxhash64("block", F.lit(1)), F.lit(groups)).cast("int"), "share": every(shares)})
        pairs = part.join(q.hint("merge"), ["g", "share"]).drop("g", "share")
        with small_batches(spark):
            new = stored(pairs.mapInArrow(run, schema), "passed")
        found = stored(best(new if found is None else found.select(new.columns).union(new)), "best")
    return found


def exact_kind(most: float) -> type:
    """The quickest number type whose sums are exact up to ``most``."""
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def first_of(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` first of each group, higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, group))
    at = group[order]
    begins = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    place = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
    return order[place < k]


def gathered(q: np.ndarray, c: np.ndarray, qi: np.ndarray, ci: np.ndarray) -> np.ndarray:
    """Inner products of listed pairs; q and c hold a dimension in each row."""
    out = np.zeros(len(qi), c.dtype)
    for a, b in zip(q, c, strict=True):
        out += a[qi] * b[ci]
    return out
