"""Exact top-k search by columnar branch-and-bound.

Candidates lie in blocks, a dimension after the other. A block of queries is multiplied
with the dimensions of largest mass first, some at a time. What the rest of the dimensions
can add to a pair's score is at most the product of both remainders' lengths
(Cauchy-Schwarz), so a pair goes once its sum and that bound cannot reach the query's
k-th best score so far. Few survivors are compacted into a list, which alone meets the
further dimensions. The first bound of a query is its k-th best in a part of the first
block; each round's k-th best bounds the next (``vectors.searched``).

Scores are exact: sums are integers that the number type used holds without rounding.

Cases as in ``vectors``; a row without vec_id takes no part. Ties go to the smaller
vec_id. Rows of equal vec_id are each searched for and found, and only a row itself is
left out of its own result. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import record
from .vectors import NONE, SPARSE, asked, blocks, exact_kind, first_of, gathered, integer_vectors, searched

#: Dimensions added at a time, and candidates of a block that give a first bound.
DIMS = 16
SEED = 512


def _vertical(v: np.ndarray) -> tuple[int, bytes]:
    most = int(np.abs(v).max(initial=0))
    size = 2 if most < 2**15 else 4
    return size, v.astype(f"<i{size}").tobytes()


def _read(kind: int, width: int, n: int, v: bytes) -> np.ndarray:
    return np.frombuffer(v, f"<i{kind}").reshape(width, n).astype(np.int64)


class _Search:
    """A task's kernel; it keeps the block of candidates that it met last."""

    def __init__(self, k: int):
        self.k, self.number = k, None

    def block(self, x: dict) -> None:
        if self.number == x["block"]:
            return
        c = _read(x["kind"], x["width"], x["n"], x["v"])
        mass = (c.astype(np.float64) ** 2).sum(axis=1)
        self.order = np.argsort(-mass, kind="stable")
        self.c, self.rest = c[self.order], self.remainders(c[self.order])
        self.ids, self.rows, self.number = np.frombuffer(x["ids"], np.int64), x["block"] + np.arange(x["n"]), x["block"]

    @staticmethod
    def remainders(v: np.ndarray) -> np.ndarray:
        """Lengths of what follows each step of dimensions, the whole first."""
        after = np.concatenate([np.cumsum((v.astype(np.float64) ** 2)[::-1], axis=0)[::-1], np.zeros((1, v.shape[1]))])
        return np.sqrt(after[[*range(0, len(v), DIMS), len(v)]])

    def __call__(self, x: dict) -> pa.RecordBatch:
        self.block(x)
        own, limits = np.frombuffer(x["q_row"], np.int64), np.frombuffer(x["q_limit"], np.int64)
        wide = np.frombuffer(x["q_q"], np.int64).reshape(x["queries"], -1)
        q = np.zeros((len(self.c), len(own)), np.int64)
        shared = min(len(q), wide.shape[1])
        q[:shared] = wide[:, :shared].T
        q = q[self.order]
        rest = self.remainders(q)
        most = float(rest[0].max(initial=0) * self.rest[0].max(initial=0))
        kind = exact_kind(most)
        # bounds are a little wider than rounding errors
        slack, bound = 1 + 1e-6 * most, np.float32 if kind is np.float32 else np.float64
        q, c, rest, mine = q.astype(kind), self.c.astype(kind), rest.astype(bound), self.rest.astype(bound)
        limits = self.seeded(q, c, own, np.maximum(limits, np.iinfo(np.int64).min // 2)).astype(kind)

        s, qi, ci = np.zeros((len(own), c.shape[1]), kind), None, None
        for step, at in enumerate(range(0, max(len(c), 1), DIMS), 1):
            last, dims = at + DIMS >= len(c), slice(at, at + DIMS)
            if qi is None:
                s += q[dims].T @ c[dims]
                alive = s >= limits[:, None] if last else s + (rest[step][:, None] * mine[step] + slack) >= limits[:, None]
                if last or np.count_nonzero(alive) <= SPARSE * alive.size:
                    qi, ci = np.nonzero(alive)
                    s = s[qi, ci]
            else:
                s = s + gathered(q[dims], c[dims], qi, ci)
                keep = s >= limits[qi] if last else s + (rest[step][qi] * mine[step][ci] + slack) >= limits[qi]
                qi, ci, s = qi[keep], ci[keep], s[keep]
        other = self.rows[ci] != own[qi]
        qi, ci, s = qi[other], ci[other], s[other].astype(np.int64)
        top = first_of(qi, s, self.ids[ci], self.k)
        return record(row=pa.array(own[qi[top]]), vec_id=pa.array(self.ids[ci[top]]), score=pa.array(s[top]))

    def seeded(self, q: np.ndarray, c: np.ndarray, own: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """Limits, where there were none the k-th best score over the block's first candidates."""
        new = np.flatnonzero(limits <= np.iinfo(np.int64).min // 2)
        if not len(new) or c.shape[1] <= self.k:
            return limits
        seed = max(SEED, self.k + 1)
        s = (q[:, new].T @ c[:, :seed]).astype(np.int64)
        s[self.rows[:seed] == own[new, None]] = np.iinfo(np.int64).min // 2
        out = limits.copy()
        out[new] = np.partition(s, -self.k, axis=1)[:, -self.k]
        return out


def top_k(df: DataFrame, asks: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """The ``k`` rows of highest score for each row of ``df (vec_id, embedding)`` that ``asks`` holds for."""
    rows = integer_vectors(df.where("vec_id is not null"), scale, F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("label"), F.coalesce(asks, F.lit(False)).alias("asked"))
    candidates = blocks(rows, _vertical)
    queries = asked(candidates, _read)

    def bounded(found: DataFrame | None) -> tuple[DataFrame, list[str]]:
        if found is None:
            return queries.withColumn("limit", F.array(F.lit(NONE))), ["limit"]
        limits = found.where(F.col("rank") == k).select("row", F.col("score").alias("limit"))
        return queries.join(limits.hint("merge"), "row", "left").withColumn("limit", F.array(F.coalesce("limit", F.lit(NONE)))), ["limit"]

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    found = searched(candidates, queries, bounded, partial(_Search, k), "row long, vec_id long, score long", best)
    return queries.select("row", F.col("id").alias("query_id")).join(found.hint("merge"), "row").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op12_topk_search(spark, sf_dir):
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


OP12_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as c from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, v.vec_id, list_inner_product(q.c, v.c)::bigint as score
  from v q join v on v.vec_id <> q.vec_id where q.vec_id % 100 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""
