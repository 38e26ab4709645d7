"""Toxicity by multiple-instance learning: sentences scored, a noisy-or of them fits document labels.

A document is toxic if any of its sentences is: P = 1 - (1 - leak) * product(1 - p), where
p is a logistic score of a sentence's words and the leak stands for labels that no
sentence explains. Only document labels are known. Words, and beginnings of words, that
go with toxic labels more than chance (``MIN_Z``) and are not too rare among them
(``MIN_SHARE``) make the dictionary; then weights, offset and leak are fitted together. The offending sentences are
those with the highest p.

The fit uses at most ``MAX_LABELLED`` labelled rows, those of the smallest hashes of their
doc_id; every document is scored whole. Their texts are stored, then their dictionary
words, a row for each document. For each step of the fit every task adds up likelihood and gradient over
its own documents, vectors of the dictionary's length, and the driver adds the tasks'
sums and takes a quasi-Newton step; all words of a document are in one row, so noisy-or
is exact. Sentences end at . ! ? and line breaks; words are runs of lower-cased letters
and digits.

Cases. A null or empty text has no sentence and gets the leak as score. Rows with equal
doc_id are scored and fitted each for itself; repeated labels count once (the largest),
null labels not at all. Without labels of both kinds there is no dictionary and the score
is the labels' mean, or 0 without any. A null doc_id is scored. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, on_workers, record, split_batch, stored, with_text
from .wordkernel import NOT_ALNUM, Points, Words, prefixes, text_of_words, words

MAX_LABELLED = 100_000
#: A dictionary word stands in so many of the toxic documents at least, in such a share of
#: them, and its z score is so high. By the share, the dictionary has at most 200 times the
#: mean number of different words and beginnings of a toxic document, whatever the sample.
MIN_TOXIC, MIN_SHARE, MIN_Z = 3, 0.005, 4.0
#: Bytes of the beginnings of words that count besides the words: inflected forms share them.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Tasks of a step of the fit, steps at most, and the gradient (a document's mean) that ends it, ten times the least gain.
TASKS, STEPS, FLAT = 16, 60, 1e-4
PENALTY = 0.01
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n")] = True


class Model(NamedTuple):
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    offset: float
    leak: float


def _features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and beginnings, and the number of the word of each."""
    parts = [(w.hash, np.arange(len(w.hash))), *(prefixes(w, n) for n in BEGINNINGS)]
    return np.concatenate([h for h, _ in parts]), np.concatenate([i for _, i in parts])


def _found(texts: pa.Array, dictionary: np.ndarray):
    """Distinct ``(text, sentence, word number)`` of dictionary words, and the texts' words and sentences, numbered over all texts."""
    w = words(pc.utf8_lower(texts.fill_null("")), NOT_ALNUM)
    of = text_of_words(w)
    sentence = np.searchsorted(np.flatnonzero(_ENDS[w.data]), w.start) + of
    if not len(dictionary):
        return np.zeros((0, 3), np.int64), w, sentence
    sieve = np.zeros(1 << 20, bool)
    sieve[dictionary >> np.uint64(44)] = True
    keys = [np.zeros(0, np.int64)]
    for n in (0, *BEGINNINGS):
        h, word = prefixes(w, n) if n else (w.hash, np.arange(len(w.hash)))
        maybe = np.flatnonzero(sieve[h >> np.uint64(44)])
        number = np.minimum(np.searchsorted(dictionary, h[maybe]), len(dictionary) - 1)
        hit = dictionary[number] == h[maybe]
        keys.append(sentence[word[maybe[hit]]] * len(dictionary) + number[hit])
    key = np.unique(np.concatenate(keys))
    found = key // len(dictionary)
    text = of[np.minimum(np.searchsorted(sentence, found), max(0, len(of) - 1))] if len(key) else key
    return np.stack([text, found, key % len(dictionary)], 1), w, sentence


def _labelled(batch: pa.RecordBatch, ids: np.ndarray, toxic: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows of the batch that are in the sample, and their labels."""
    own = batch.column("doc_id").cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(ids, own), max(0, len(ids) - 1))
    keep = (ids[at] == own) & pc.is_valid(batch.column("doc_id")).to_numpy(zero_copy_only=False) if len(ids) else np.zeros(len(own), bool)
    return batch.filter(pa.array(keep)), toxic[at[keep]] if len(ids) else toxic


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "toxic") -> Model:
    spark = docs.sparkSession
    on_workers(spark)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("toxic"))
    rows = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED).collect()  # the documented bound
    rows.sort()
    ids, toxic = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
    positive = int(toxic.sum())
    if not 0 < positive < len(ids):
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, positive / len(ids) if rows else 0.0)
    known = spark.sparkContext.broadcast((ids, toxic))

    def labelled(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch, y = _labelled(batch, *known.value)
        return record(toxic=pa.array(y), text=batch.column("text"))

    # bounded rows, read by each step below instead of the corpus
    sample = stored(map_batches(docs, labelled, "toxic long, text string").repartition(TASKS), "labelled")

    def once(text: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Each word once for each text that has it."""
        order = np.lexsort((text, word))
        text, word = text[order], word[order]
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (text[1:] != text[:-1])
        return word[new]

    def toxic_words(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = words(pc.utf8_lower(batch.column("text")), NOT_ALNUM)
        h, word = _features(w)
        found, times = np.unique(once(text_of_words(w)[word], h), return_counts=True)
        return record(word=found.view(np.int64), toxic=times.astype(np.int64))

    frequent = map_batches(sample.where("toxic = 1"), toxic_words, "word long, toxic long").groupBy("word").agg(F.sum("toxic").alias("toxic")).where(F.col("toxic") >= max(MIN_TOXIC, MIN_SHARE * positive))
    rows = sorted((int(np.int64(r.word).view(np.uint64)), r.toxic) for r in frequent.collect())
    candidates, of_toxic = np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64)
    shared = spark.sparkContext.broadcast(candidates)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value) + 1, np.int64)
        for batch in batches:
            for part in split_batch(batch):
                triple, _, _ = _found(part.column("text"), shared.value)
                total[:-1] += np.bincount(once(triple[:, 0], triple[:, 2]), minlength=len(shared.value))
                total[-1] += part.num_rows
        yield record(n=pa.array([total.tobytes()], pa.binary()))

    n = sum(np.frombuffer(r.n, np.int64) for r in sample.mapInArrow(documents, "n binary").collect())  # a row for each task
    m, n = n[-1], n[:-1]
    rate = positive / len(ids)
    dictionary = candidates[(of_toxic - rate * n) / np.sqrt(n * rate * (1 - rate) + 1) >= MIN_Z]
    if not len(dictionary):
        return Model(dictionary, np.zeros(0), -20.0, rate)
    shared = spark.sparkContext.broadcast(dictionary)

    def instances(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The words of each document's sentences, -1 before each sentence."""
        triple, _, _ = _found(batch.column("text"), shared.value)
        new = np.ones(len(triple), bool)
        new[1:] = triple[1:, 1] != triple[:-1, 1]
        flat = np.insert(triple[:, 2], np.flatnonzero(new), -1)
        ends = np.searchsorted(triple[:, 0], np.arange(batch.num_rows + 1))
        at = ends + np.append(0, np.cumsum(new))[ends]
        return record(toxic=batch.column("toxic"), words=pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.astype(np.int32))))

    found = stored(map_batches(sample, instances, "toxic long, words array<int>"), "instances")

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        at = spark.sparkContext.broadcast(x)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(x) + 1)
            for batch in batches:
                lists = batch.column("words")
                flat, of = lists.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                word = flat >= 0
                total += likelihood(batch.column("toxic").to_numpy(), of[word], np.cumsum(~word)[word], flat[word], at.value)
            yield record(sums=pa.array([total.tobytes()], pa.binary()))

        total = sum(np.frombuffer(r.sums) for r in found.mapInArrow(sums, "sums binary").collect())  # a row for each task
        at.destroy()
        weights = np.append(x[:-2], [0.0, 0.0])
        return -(total[0] - PENALTY / 2 * (weights @ weights)) / m, -(total[1:] - PENALTY * weights) / m

    x = least(value, np.concatenate([np.full(len(dictionary), 1.0), [-1.0, np.log(0.05)]]))
    return Model(dictionary, x[:-2], float(x[-2]), float(1 / (1 + np.exp(-x[-1]))))


def likelihood(toxic: np.ndarray, of: np.ndarray, sentence: np.ndarray, word: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The log-likelihood of documents and its gradient by ``x`` (weights, offset, the leak's log-odds), one after another.

    ``of``, ``sentence`` and ``word`` have a row for each dictionary word of a sentence, by document and sentence.
    """
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (sentence[1:] != sentence[:-1])
    group, document = np.cumsum(new) - 1, of[new]
    p = 1 / (1 + np.exp(-np.clip(np.bincount(group, x[word], len(document)) + x[-2], -30, 30)))
    leak = 1 / (1 + np.exp(-x[-1]))
    none = np.log1p(-leak) + np.bincount(document, np.log1p(-np.minimum(p, 1 - 1e-9)), len(toxic))
    none = np.minimum(none, -1e-9)
    value = np.where(toxic == 1, np.log(-np.expm1(none)), none).sum()
    # clean documents pull against any sentence, toxic ones for theirs by their odds
    pull = np.where(toxic == 1, -np.exp(none) / -np.expm1(none), 1.0)
    slope = -p * pull[document]
    return np.concatenate([[value], np.bincount(word, slope[group], len(x) - 2), [slope.sum(), (-leak * pull).sum()]])


def least(value: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, memory: int = 8) -> np.ndarray:
    """A least point of ``value`` (value and gradient) by the limited-memory quasi-Newton method with shrinking steps."""
    f, g = value(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        if np.abs(g).max() < FLAT:
            break
        d, factors = -g, []
        for s, y in reversed(past):
            factors.append((s @ d) / (s @ y))
            d = d - factors[-1] * y
        d *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / np.abs(g).max()
        for (s, y), a in zip(past, reversed(factors), strict=True):
            d = d + (a - (y @ d) / (s @ y)) * s
        step = min(1.0, 3 / max(1e-9, np.abs(d).max()))  # no weight moves by more than 3 at once
        while True:
            new, g_new = value(x + step * d)
            if new <= f + 1e-4 * step * (g @ d) or step < 1e-3:
                break
            step /= 4
        if new > f:
            break
        s, y = step * d, g_new - g
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
        done = f - new < FLAT / 10
        x, f, g = x + s, new, g_new
        if done:
            break
    return x


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "toxic", threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted, n_offending, worst_start, worst_end)``.

    Offending sentences score 0.5 or more by themselves; the worst one's code points are given, or null.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    docs = with_text(docs, "doc_id")
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, held_out, label))

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = model.value
        triple, w, sentence = _found(batch.column("text"), known.words)
        pair, at = np.unique(triple[:, 0] << 40 | triple[:, 1], return_inverse=True)
        row, sentences = pair >> 40, pair & ((1 << 40) - 1)
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at.ravel(), known.weights[triple[:, 2]], len(pair)) + known.offset, -30, 30)))
        n = batch.num_rows
        none = np.log1p(-min(known.leak, 1 - 1e-9)) + np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-12)), n)
        worst = {}
        for r, s, q in zip(row.tolist(), sentences.tolist(), p.tolist(), strict=True):
            if q >= 0.5 and q > worst.get(r, (0,))[0]:
                worst[r] = q, s
        start, end = [None] * n, [None] * n
        if worst:
            original = words(batch.column("text"), NOT_ALNUM)  # the same words as in lower case
            points = Points(original.data)
            for r, (_, s) in worst.items():
                a, b = w.word_at[r], w.word_at[r + 1]
                x, y = a + np.searchsorted(sentence[a:b], s), a + np.searchsorted(sentence[a:b], s, "right")
                zero = points[original.text_at[r]]
                start[r], end[r] = int(points[original.start[x]] - zero), int(points[original.end[y - 1]] - zero)
        return record(doc_id=batch.column("doc_id"), score=-np.expm1(none), n_offending=np.bincount(row[p >= 0.5], minlength=n).astype(np.int64), worst_start=pa.array(start, pa.int64()), worst_end=pa.array(end, pa.int64()))

    scored = map_batches(docs, score, f"doc_id {key}, score double, n_offending long, worst_start long, worst_end long")
    return scored.select("doc_id", F.coalesce(held_out, F.lit(True)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "n_offending", "worst_start", "worst_end")


def op8_toxicity(spark, sf_dir):
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return toxicity_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out)
