"""Hard-negative mining by bit-sliced integer products.

Candidates lie in blocks as bit-planes of their components, two's complement. A block of
anchors is multiplied with one plane after the other, the most significant first. What
planes still to come can add to a pair's score lies between the sums of the anchor's
negative and positive components times the value of those planes, so each pair has an
interval that halves with each plane. A pair goes once its interval cannot qualify:

* for positives (same label), if it ends below the anchor's k-th best score so far;
* for negatives (another label), if it meets none of the bands that the anchor's positives
  give, or ends below the n-th best score so far in each.

Few survivors are compacted into a list, which alone meets further planes. Bounds come from
a part of the first block, then from each round's result (``vectors.searched``). Scores are
exact integers.

Cases as in ``vectors``; a row without vec_id or label takes no part, neither as anchor nor
as candidate. Ties go to the smaller vec_id. Rows of equal vec_id are each an anchor, and
only a row itself is left out of its own result. An anchor without positives, or a positive
without negatives, has no rows. Other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import record, stored
from .vectors import NONE, SPARSE, asked, blocks, exact_kind, first_of, integer_vectors, searched

SEED = 512
_LEAST = NONE // 2


def _planes(v: np.ndarray) -> tuple[int, bytes]:
    """Bit-planes of a block, the sign's first."""
    planes = 1 + max(int(v.max(initial=0)).bit_length(), int(-1 - v.min(initial=0)).bit_length())
    return planes, b"".join(np.packbits((v >> p & 1).astype(np.uint8), axis=1).tobytes() for p in range(planes - 1, -1, -1))


def _values(planes: int) -> list[int]:
    return [-(1 << planes - 1), *(1 << p for p in range(planes - 2, -1, -1))]


def _plane(packed: bytes, place: int, width: int, n: int) -> np.ndarray:
    size = width * -(-n // 8)
    return np.unpackbits(np.frombuffer(packed, np.uint8, size, place * size).reshape(width, -1), axis=1, count=n)


def _read(planes: int, width: int, n: int, packed: bytes) -> np.ndarray:
    out = np.zeros((width, n), np.int64)
    for place, value in enumerate(_values(planes)):
        out += value * _plane(packed, place, width, n).astype(np.int64)
    return out


class _Sliced:
    """What both kernels share: a block of candidates, its planes made once each when first met."""

    def __init__(self):
        self.number = None

    def block(self, x: dict) -> None:
        if self.number == x["block"]:
            return
        self.x, self.made, self.number = x, {}, x["block"]
        self.ids, self.labels, self.rows = np.frombuffer(x["ids"], np.int64), np.frombuffer(x["labels"], np.int64), x["block"] + np.arange(x["n"])
        # no component is larger than its highest plane's value
        self.largest = 1 << x["kind"] - 1

    def plane(self, place: int, kind: type) -> np.ndarray:
        if (place, kind) not in self.made:
            self.made[place, kind] = _plane(self.x["v"], place, self.x["width"], self.x["n"]).astype(kind)
        return self.made[place, kind]

    def anchors(self, x: dict) -> np.ndarray:
        """The anchors of a block, cut or filled with zeros to the candidates' dimensions."""
        wide = np.frombuffer(x["q_q"], np.int64).reshape(x["queries"], -1)
        a = np.zeros((len(wide), x["width"]), np.int64)
        a[:, : min(a.shape[1], wide.shape[1])] = wide[:, : a.shape[1]]
        return a

    def product(self, a: np.ndarray, some: slice) -> np.ndarray:
        """Whole scores of anchors with some of the candidates."""
        kind = exact_kind(float(np.abs(a).sum(axis=1).max(initial=0)) * self.largest)
        return sum((value * (a.astype(kind) @ self.plane(place, kind)[:, some]) for place, value in enumerate(_values(self.x["kind"]))), np.zeros((len(a), 1), kind)).astype(np.int64)

    def narrowed(self, a: np.ndarray, some: slice, fits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors' and candidates' places and scores of the pairs whose intervals (low, high) fit to the end.

        ``fits(low, high, anchors, candidates)`` gets whole matrices with broadcastable places, later lists.
        """
        kind = exact_kind(float(np.abs(a).sum(axis=1).max(initial=0)) * self.largest * 2)
        ends = [np.minimum(a, 0).sum(axis=1).astype(kind), np.maximum(a, 0).sum(axis=1).astype(kind)]
        a = a.astype(kind)
        columns = np.arange(self.x["n"])[some]
        s, qi, ci = np.zeros((len(a), len(columns)), kind), None, None
        for place, value in enumerate(_values(self.x["kind"])):
            plane, rest = self.plane(place, kind), kind(abs(value) - 1)
            if qi is None:
                s += kind(value) * (a @ plane[:, some])
                alive = fits(s + (rest * ends[0])[:, None], s + (rest * ends[1])[:, None], np.arange(len(a))[:, None], columns[None, :])
                if rest == 0 or np.count_nonzero(alive) <= SPARSE * alive.size:
                    qi, ci = np.nonzero(alive)
                    s, ci = s[qi, ci], columns[ci]
            else:
                for i in range(0, len(qi), 1 << 16):
                    part = slice(i, i + (1 << 16))
                    s[part] += kind(value) * np.einsum("ij,ji->i", a[qi[part]], plane[:, ci[part]])
                keep = fits(s + rest * ends[0][qi], s + rest * ends[1][qi], qi, ci)
                qi, ci, s = qi[keep], ci[keep], s[keep]
        other = self.rows[ci] != self.own[qi]
        return qi[other], ci[other], s[other].astype(np.int64)


class _Positives(_Sliced):
    def __init__(self, k: int):
        super().__init__()
        self.k = k

    def __call__(self, x: dict) -> pa.RecordBatch:
        self.block(x)
        a, rows, labels, limits = self.anchors(x), *(np.frombuffer(x[f"q_{c}"], np.int64) for c in ("row", "label", "limit"))
        found = []
        for label in np.intersect1d(labels, self.labels):
            mine = np.flatnonzero(labels == label)
            some = slice(*np.searchsorted(self.labels, [label, label + 1]))  # rows of a block are in order of their labels
            self.own = rows[mine]
            low = self.seeded(a[mine], some, np.maximum(limits[mine], _LEAST))
            qi, ci, s = self.narrowed(a[mine], some, lambda _, high, q, c, low=low: high >= low[q])
            top = first_of(qi, s, self.ids[ci], self.k)
            found.append((rows[mine][qi[top]], self.ids[ci[top]], s[top]))
        row, vec_id, score = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3
        return record(row=pa.array(row), vec_id=pa.array(vec_id), score=pa.array(score))

    def seeded(self, a: np.ndarray, some: slice, low: np.ndarray) -> np.ndarray:
        """Bounds, where there were none the k-th best score over the first candidates."""
        new, first = np.flatnonzero(low == _LEAST), slice(some.start, min(some.stop, some.start + max(SEED, self.k + 1)))
        if len(new) and first.stop - first.start > self.k:
            s = self.product(a[new], first)
            s[self.rows[first] == self.own[new, None]] = _LEAST
            low = low.copy()
            low[new] = np.partition(s, -self.k, axis=1)[:, -self.k]
        return low


class _Negatives(_Sliced):
    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __call__(self, x: dict) -> pa.RecordBatch:
        self.block(x)
        self.own, labels = np.frombuffer(x["q_row"], np.int64), np.frombuffer(x["q_label"], np.int64)
        a = self.anchors(x)
        low, high, limit = (np.frombuffer(x[f"q_{c}"], np.int64).reshape(len(a), -1) for c in ("low", "high", "limit"))
        if not a.size or not low.size:  # without dimensions all scores are 0
            a = np.zeros((len(self.own), x["width"]), np.int64)
        low = self.seeded(a, labels, np.maximum(low, limit), high)
        empty = low > high
        # an interval that meets a band meets the span of all of them
        least, most = np.where(empty, -_LEAST, low).min(axis=1, initial=-_LEAST), np.where(empty, _LEAST, high).max(axis=1, initial=_LEAST)
        qi, ci, s = self.narrowed(a, slice(0, x["n"]), lambda lo, hi, q, c: (hi >= least[q]) & (lo <= most[q]) & (labels[q] != self.labels[c]))
        found = []
        for place in range(low.shape[1]):
            at = np.flatnonzero((s >= low[qi, place]) & (s <= high[qi, place]))
            at = at[first_of(qi[at], s[at], self.ids[ci[at]], self.n)]
            found.append((self.own[qi[at]], np.full(len(at), place), self.ids[ci[at]], s[at]))
        row, place, vec_id, score = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 4
        return record(row=pa.array(row), place=pa.array(place, pa.int32()), vec_id=pa.array(vec_id), score=pa.array(score))

    def seeded(self, a: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Lower ends of bands, raised to the n-th best score in the band over the first candidates."""
        first = slice(0, max(SEED, self.n))
        if len(self.rows) < self.n or not len(a):
            return low
        s = self.product(a, first)
        s = np.where(labels[:, None] != self.labels[None, first], np.broadcast_to(s, (len(a), len(self.labels[first]))), _LEAST)
        out = low.copy()
        for place in range(low.shape[1]):
            within = np.where((s >= low[:, [place]]) & (s <= high[:, [place]]), s, _LEAST)
            out[:, place] = np.maximum(low[:, place], np.partition(within, -self.n, axis=1)[:, -self.n])
        return out


def hard_negatives(df: DataFrame, asks: Column, label: Column, positives: int = 5, negatives: int = 3, scale: int = 256, band: tuple[int, int] = (50, 95)) -> DataFrame:
    """For each row of ``df (vec_id, embedding)`` that ``asks`` holds for and each of its best positives, the best negatives.

    A negative's score lies within ``band``, in percent of the positive's.
    """
    rows = df.select("vec_id", "embedding", label.cast("long").alias("label"), F.coalesce(asks, F.lit(False)).alias("asked")).where("vec_id is not null and label is not null")
    rows = integer_vectors(rows, scale, F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("asked"))
    candidates = blocks(rows, _planes)
    anchors = asked(candidates, _read)

    def bounded(found: DataFrame | None) -> tuple[DataFrame, list[str]]:
        if found is None:
            return anchors.withColumn("limit", F.array(F.lit(NONE))), ["limit"]
        limits = found.where(F.col("rank") == positives).select("row", F.col("score").alias("limit"))
        return anchors.join(limits.hint("merge"), "row", "left").withColumn("limit", F.array(F.coalesce("limit", F.lit(NONE)))), ["limit"]

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)

    near = searched(candidates, anchors, bounded, partial(_Positives, positives), "row long, vec_id long, score long", best)
    # parts[0] <= 100 * negative / positive <= parts[1]; a positive below zero has no band
    p = F.col("positive_score")
    least, most = band
    low = F.expr(f"positive_score div 100 * {least} + (positive_score % 100 * {least} + 99) div 100")
    high = F.expr(f"positive_score div 100 * {most} + positive_score % 100 * {most} div 100")
    near = near.select("row", (F.col("rank") - 1).cast("int").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    near = near.select("*", F.when(p < 0, 1).otherwise(low).alias("low"), F.when(p < 0, 0).otherwise(high).alias("high"))

    def banded(found: DataFrame | None) -> tuple[DataFrame, list[str]]:
        bands = near.withColumn("limit", F.lit(NONE))
        if found is not None:
            limits = found.where(F.col("rank") == negatives).select("row", "place", F.col("score").alias("limit"))
            bands = near.join(limits.hint("merge"), ["row", "place"], "left").withColumn("limit", F.coalesce("limit", F.lit(NONE)))
        lists = ["low", "high", "limit"]
        # an anchor has a few positives at most; places without one have the empty band 0 to -1
        of = lambda c, other: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.try_element_at(F.col(c), i), F.lit(other)))
        bands = bands.groupBy("row").agg(*(F.map_from_entries(F.collect_list(F.struct("place", c))).alias(c) for c in lists))
        return anchors.join(bands.select("row", *(of(c, other).cast("array<long>").alias(c) for c, other in zip(lists, (0, -1, NONE), strict=True))).hint("merge"), "row"), lists

    def best_of_band(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("row", "place").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)

    far = searched(candidates, anchors, banded, partial(_Negatives, negatives), "row long, place int, vec_id long, score long", best_of_band)
    near = near.join(anchors.select("row", F.col("id").alias("anchor_id")).hint("merge"), "row").join(far.hint("merge"), ["row", "place"])
    return near.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(df, F.col("vec_id") % 50 == 0, moved)


OP11_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as c from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.c, b.c)::bigint as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0
), p as (
  select * from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as place from s where same) where place <= 5
), n as (
  select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.place order by s.score desc, s.vec_id)::integer as rank
  from p join s on s.anchor_id = p.anchor_id and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3
"""
