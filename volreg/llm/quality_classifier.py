"""Quality scores by ridge regression on random Fourier features of document statistics.

Statistics of each whole text are standardised with the means and deviations of all
training rows and mapped to random Fourier features, whose products approximate a
Gaussian kernel. Each task sums its part of the normal equations; their sums have a size
fixed by ``FEATURES`` and are solved on the driver. Scores are calibrated by isotonic
regression on counts in fixed bins, of scores by weights that were fitted without the
row's own fold: training rows are dealt to ``FOLDS`` by the hash of their doc_id.

Cases. A null or empty text has the statistics of an empty one and gets a score. Rows
with equal doc_id are scored each for itself; labels that repeat count each time, null
labels not at all. Without labels of both kinds every score is the labels' mean, or 0.5
without any. A null doc_id is scored and held out of training. Tables without rows give
none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, on_workers, record, stored, with_text
from .wordkernel import LOWER, SPACE, inner_windows, per_text, text_of_words, words

FEATURES = 256
#: Width of the Gaussian kernel over standardised statistics.
WIDTH = 4.0
RIDGE = 1e-3
BINS = 1000
FOLDS = 5
SEED = 7

STATISTICS = ["log_words", "word_length", "symbols", "upper", "digits", "stops", "bars", "bangs", "distinct", "repeated", "line_words", "top_word", "beyond_ascii", "short_words", "other_marks", "full_lines"]


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_SYMBOLS, _UPPER, _DIGITS, _STOPS = _class("#*$%&<>{}~^=_\\"), _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789"), _class(".,;:")
_OTHER = _class("@/()[]\"'+-`")


def statistics(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row of statistics, each between fixed bounds or a logarithm, for each text."""
    w = words(batch.column("text"), SPACE, LOWER)
    n = np.diff(w.word_at)
    bytes_ = np.diff(w.text_at)
    per_byte, per_word = np.maximum(1, bytes_), np.maximum(1, n)
    share = lambda table: per_text(table[w.data], w.text_at) / per_byte
    of = text_of_words(w)
    order = np.lexsort((w.hash, of))
    first = np.ones(len(order), bool)
    first[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order][first], minlength=len(n))
    at = np.flatnonzero(first)
    top = np.zeros(len(n), np.int64)
    np.maximum.at(top, of[order][at], np.diff(np.append(at, len(order))))
    h, start = inner_windows(w, 3)
    order = np.lexsort((h, of[start]))
    again = np.zeros(len(h), bool)
    again[1:] = (h[order][1:] == h[order][:-1]) & (of[start][order][1:] == of[start][order][:-1])
    repeated = np.bincount(of[start][order][again], minlength=len(n))
    newline = w.data == 10
    lines = per_text(newline, w.text_at) + 1
    full = newline.copy()
    full[1:] &= np.isin(w.data[:-1], list(b".!?"))
    columns = [
        np.log1p(n), np.minimum(20, bytes_ / per_word) / 20, share(_SYMBOLS), share(_UPPER), share(_DIGITS), share(_STOPS), share(_class("|")), share(_class("!")), distinct / per_word, repeated / per_word,
        np.log1p(n / lines), top / per_word, per_text(w.data > 127, w.text_at) / per_byte, per_text((w.end - w.start) <= 3, w.word_at) / per_word, share(_OTHER), per_text(full, w.text_at) / lines,
    ]
    return record(doc_id=batch.column("doc_id"), **dict(zip(STATISTICS, columns, strict=True)))


class Fourier:
    """The map from raw statistics to random features; fixed by the seed, the means and the deviations."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray):
        random = np.random.default_rng(SEED)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.direction = random.normal(size=(len(mean), FEATURES)) / WIDTH
        self.phase = random.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in STATISTICS], 1)
        x = np.clip((x - self.mean) / self.deviation, -6, 6)
        return np.hstack([np.ones((len(x), 1)), np.sqrt(2 / FEATURES) * np.cos(x @ self.direction + self.phase)])


def normal_equations(train: DataFrame, fourier: Fourier) -> tuple[np.ndarray, np.ndarray]:
    """For each fold the sums of z z' and z y over its rows of ``train``: a table of fixed size for each task and fold."""
    on_workers(train.sparkSession)
    size = FEATURES + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, size, size + 1))
        for batch in batches:
            z, fold = fourier(batch), batch.column("fold").to_numpy()
            y = np.hstack([z, batch.column("label").to_numpy(zero_copy_only=False)[:, None]])
            for i in range(FOLDS):
                total[i] += z[fold == i].T @ y[fold == i]
        for i in np.flatnonzero(total.any((1, 2))):
            yield record(fold=pa.array([i], pa.int32()), sums=pa.array([total[i].tobytes()], pa.binary()))

    def add(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0
        for part in parts:
            for x in part["sums"]:
                total = total + np.frombuffer(x)
        yield pd.DataFrame({"fold": [key[0]], "sums": [total.tobytes()]})

    total = np.zeros((FOLDS, size, size + 1))
    for i, x in train.mapInArrow(sums, "fold int, sums binary").groupBy("fold").applyInPandas(add, "fold int, sums binary").collect():
        total[i] = np.frombuffer(x).reshape(size, size + 1)
    return total[:, :, :size], total[:, :, size]


def ridge(a: np.ndarray, b: np.ndarray, n: float) -> np.ndarray:
    """Weights of summed normal equations over n rows; the constant's is free."""
    penalty = np.full(len(b), RIDGE * n + 0.1)
    penalty[0] = 1e-9
    return np.linalg.lstsq(a + np.diag(penalty), b, rcond=None)[0]


def isotonic(n: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Rising rates closest to those of the bins; bins without rows take their neighbours' between."""
    used = np.flatnonzero(n)
    groups: list[list[float]] = []
    for i in used:
        groups.append([positive[i], n[i], 1])
        while len(groups) > 1 and groups[-2][0] * groups[-1][1] >= groups[-1][0] * groups[-2][1]:
            p, m, k = groups.pop()
            groups[-1] = [groups[-1][0] + p, groups[-1][1] + m, groups[-1][2] + k]
    rates = np.concatenate([np.full(k, p / m) for p, m, k in groups])
    return np.interp(np.arange(len(n)), used, rates)


def train_part(held_out: Column, labels: DataFrame, label: str) -> DataFrame:
    return labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out).select("doc_id", F.col(label).cast("double").alias("label"))


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "quality") -> DataFrame:
    """``(doc_id, held_out, score, predicted)``; labels of rows where ``held_out`` (of doc_id) holds are not read."""
    spark = docs.sparkSession
    key = docs.schema["doc_id"].dataType.simpleString()
    stats = stored(map_batches(with_text(docs, "doc_id"), statistics, f"doc_id {key}, " + ", ".join(f"{c} double" for c in STATISTICS)), "statistics")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    train = stored(stats.join(train_part(held_out, labels, label), "doc_id").select(*STATISTICS, "label", fold), "training")
    sums = train.agg(F.count("*"), F.sum("label"), *(F.avg(c) for c in STATISTICS), *(F.stddev_pop(c) for c in STATISTICS)).first()
    n, positive = sums[0], sums[1] or 0
    flag = F.coalesce(held_out, F.lit(True)).alias("held_out")
    if not 0 < positive < n:
        score = F.lit(positive / n if n else 0.5)
        return stats.select("doc_id", flag, score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"))
    d = len(STATISTICS)
    fourier = Fourier(np.array(sums[2 : 2 + d]), np.array(sums[2 + d : 2 + 2 * d]))
    a, b = normal_equations(train, fourier)
    size = a[:, 0, 0]  # the constant's square, summed: each fold's rows
    weights = ridge(a.sum(0), b.sum(0), n)
    without = np.stack([ridge(a.sum(0) - a[i], b.sum(0) - b[i], n - size[i]) if size[i] < n else weights for i in range(FOLDS)])
    on_workers(spark)

    def binned(raw: np.ndarray) -> np.ndarray:
        return np.clip(((raw + 0.25) / 1.5 * BINS).astype(np.int64), 0, BINS - 1)

    def left_out(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = (fourier(batch) * without[batch.column("fold").to_numpy()]).sum(1)
        return record(bin=pa.array(binned(raw), pa.int64()), label=batch.column("label"))

    counts = map_batches(train, left_out, "bin long, label double")
    n_bin, positive_bin = np.zeros(BINS), np.zeros(BINS)
    for i, m, p in counts.groupBy("bin").agg(F.count("*"), F.sum("label")).collect():  # BINS rows at most
        n_bin[i], positive_bin[i] = m, p
    curve = isotonic(n_bin, positive_bin)

    scored = map_batches(stats, lambda batch: record(doc_id=batch.column("doc_id"), score=curve[binned(fourier(batch) @ weights)]), f"doc_id {key}, score double")
    return scored.select("doc_id", flag, "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op7_quality_classifier(spark, sf_dir):
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out)
