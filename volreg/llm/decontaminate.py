"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Benchmark items are a stated query set, taken in blocks of ``BLOCK_CHARS`` characters at
most, so what is broadcast has a fixed bound. For each block the documents that hold each
word 3-gram of an item are counted over the whole corpus; the rare ones of an item seed
it: those in at most ``RARE`` times as many documents as the item's own lower quartile,
and at any rate its rarest ``SEEDED`` of all, so only a tenth that is far more common than
the rest seeds nothing. However many documents hold one edited or shortened copy, it has a
seed as long as it keeps more than a tenth of the item's 3-grams. A passage around seeds
is aligned with the item word by word; the local alignment's score over that of the item
with itself must reach ``MIN_SCORE``, and ``MIN_ALIGNED`` words, or all of a shorter item,
must be aligned with equal ones. Every passage that passes is found: what is left of the
text on both sides of one is aligned again. Items of one or two words have no 3-gram and
are looked for as they are.

Words are runs of lower-cased letters and digits. Cases. Null and empty texts match
nothing; items without words neither. Repeated rows and items are matched each for itself.
A null doc_id or item_id is handed on. Of equal alignments the first in the text counts.
Tables without rows give none. ``decontaminated`` leaves items of fewer than
``MIN_ITEM_WORDS`` words aside, as a phrase of three words is no leak.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import map_batches, on_workers, record, split_batch, with_text
from .wordkernel import NOT_ALNUM, Points, Words, inner_windows, text_of_words, windows, words

SEED = 3
#: Words of an item whose passages make a document go.
MIN_ITEM_WORDS = 5
RARE = 4
#: Share of an item's 3-grams, rarest first, that seed it whatever their counts.
SEEDED = 0.9
MIN_SCORE = 0.5
MIN_ALIGNED = 8
BLOCK_CHARS = 8_000_000
#: Alignment: a match counts 1, a mismatch and each word of a gap cost so much.
COST = 0.5
_FILTER_BITS = 20


def _words(texts: pa.Array) -> Words:
    return words(pc.utf8_lower(texts.fill_null("")), NOT_ALNUM)


class Index:
    """The 3-grams of a block of items, or the whole of shorter ones, and which items have them where."""

    def __init__(self, texts: list[str], min_words: int = 1):
        w = _words(pa.array(texts, pa.string()))
        self.items = [w.hash[a:b] for a, b in zip(w.word_at[:-1], w.word_at[1:], strict=True)]
        size = np.diff(w.word_at)
        parts = [(windows(w.hash[:0], SEED), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for n in range(1, SEED + 1):
            h, first = inner_windows(w, n)
            item = text_of_words(w)[first]
            own = (size[item] >= min_words) & ((size[item] == n) if n < SEED else True)
            parts.append((h[own], item[own], (first - w.word_at[item])[own]))
        h, item, place = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        self.grams, self.at = np.unique(h[order], return_index=True)
        self.at = np.append(self.at, len(h))
        self.item, self.place = item[order], place[order]
        self.lengths = sorted({min(int(n), SEED) for n in size if n >= min_words and n})
        self._sieve()

    def _sieve(self) -> None:
        self.sieve = np.zeros(1 << _FILTER_BITS, bool)
        self.sieve[(self.grams & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True

    def found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``h`` are 3-grams of the block, and their numbers."""
        maybe = np.flatnonzero(self.sieve[(h & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
        number = np.searchsorted(self.grams, h[maybe])
        number[number == len(self.grams)] = 0
        hit = self.grams[number] == h[maybe] if len(self.grams) else np.zeros(len(maybe), bool)
        return maybe[hit], number[hit]

    def in_texts(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """The first words of the texts' runs that are seeds, and the seeds' numbers."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for n in self.lengths:
            h, first = inner_windows(w, n)
            where, gram = self.found(h)
            out.append((first[where], gram))
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])

    def keep_rare(self, documents: np.ndarray) -> None:
        """Drop the 3-grams that are not rare for their item."""
        gram = np.repeat(np.arange(len(self.grams)), np.diff(self.at))
        n = documents[gram]
        # an item's counts side by side, rising: its quartile and its share of seeds are at places
        order = np.lexsort((n, self.item))
        size = np.bincount(self.item, minlength=len(self.items))
        start = np.cumsum(size) - size
        some = size > 0
        at = (size[some] - 1) * 0.25
        low, high = start[some] + np.floor(at).astype(np.int64), start[some] + np.ceil(at).astype(np.int64)
        limit = np.zeros(len(self.items))
        quartile = n[order[low]] + (n[order[high]] - n[order[low]]) * (at - np.floor(at))
        share = n[order[start[some] + np.ceil((size[some] - 1) * SEEDED).astype(np.int64)]]
        limit[some] = np.maximum(RARE * np.maximum(1, quartile), share)
        rare = n <= limit[self.item]
        counts = np.bincount(gram[rare], minlength=len(self.grams))
        self.item, self.place = self.item[rare], self.place[rare]
        self.grams = self.grams[counts > 0]
        self.at = np.concatenate([[0], np.cumsum(counts[counts > 0])])
        self._sieve()


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
    """Best local alignment score and the end in the passage (its first best cell's)."""
    n = len(passage)
    fall = COST * np.arange(n + 1)
    row, best, end = np.zeros(n + 1), 0.0, 0
    for word in item:
        step = np.zeros(n + 1)
        step[1:] = np.maximum(row[:-1] + np.where(passage == word, 1.0, -COST), row[1:] - COST)
        np.maximum(step, 0, out=step)
        row = np.maximum.accumulate(step + fall) - fall  # gaps in the item
        top = int(row.argmax())
        if row[top] > best:
            best, end = float(row[top]), top
    return best, end


def aligned(item: np.ndarray, passage: np.ndarray) -> int:
    """Equal words in the best local alignment; the most of equal scores."""
    tiny = 2.0**-20  # a match counts a little more, so that the score's fraction has the number of matches
    row, best = np.zeros(len(passage) + 1), 0.0
    fall = COST * np.arange(len(passage) + 1)
    for word in item:
        step = np.zeros(len(passage) + 1)
        step[1:] = np.maximum(row[:-1] + np.where(passage == word, 1.0 + tiny, -COST), row[1:] - COST)
        row = np.maximum.accumulate(np.maximum(step, 0) + fall) - fall
        best = max(best, float(row.max()))
    return round(best % COST / tiny)


def passages(item: np.ndarray, text: np.ndarray, seeds: np.ndarray) -> list[tuple[float, int, int]]:
    """``(score, first word, end word)`` of the alignments of ``item`` in the words ``text`` that are good enough and hold a seed's place."""
    least, out = min(MIN_ALIGNED, len(item)), []
    parts = [(0, len(text))]
    while parts:
        x, y = parts.pop()
        part = text[x:y]
        # without a seed, or with too few of the item's words, no alignment counts
        if np.searchsorted(seeds, y) == np.searchsorted(seeds, x) or np.isin(item, part).sum() < max(MIN_SCORE * len(item), least):
            continue
        score, end = align(item, part)
        if score < MIN_SCORE * len(item):
            continue
        _, back = align(item[::-1], part[:end][::-1])
        start, end = x + end - back, x + end
        if np.searchsorted(seeds, end) > np.searchsorted(seeds, start) and (score >= least or aligned(item, text[start:end]) >= least):
            out.append((score, start, end))
        parts += [(x, start), (end, y)]
    return sorted(out, key=lambda p: p[1])


def matches(batch: pa.RecordBatch, index: Index) -> list[tuple]:
    """``(row, item, score, first word, end word, seeds)`` of the batch's texts."""
    w = _words(batch.column("text"))
    first, gram = index.in_texts(w)
    if not len(first):
        return []
    times = index.at[gram + 1] - index.at[gram]
    entry = np.repeat(index.at[gram], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    row, word = np.repeat(text_of_words(w)[first], times), np.repeat(first, times)
    item = index.item[entry]
    order = np.lexsort((word, item, row))
    row, word, item = row[order], word[order], item[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
    begin = np.flatnonzero(new)
    out: list[tuple] = []
    for a, b in zip(begin.tolist(), np.append(begin[1:], len(row)).tolist(), strict=True):
        r, i, seeds = int(row[a]), int(item[a]), word[a:b]
        target = index.items[i]
        # a passage that scores enough spans less than twice the item's words, so windows around seeds have all of it
        span, k, done = 2 * len(target), 0, int(w.word_at[r])
        while k < len(seeds):
            to = int(np.searchsorted(seeds, seeds[k] + span, "right"))
            lo, hi = max(done, int(seeds[k]) - span), min(int(w.word_at[r + 1]), int(seeds[to - 1]) + SEED + span)
            for score, x, y in passages(target, w.hash[lo:hi], seeds[k:to] - lo):
                out.append((r, i, score / len(target), lo + x, lo + y, int(np.searchsorted(seeds, lo + y) - np.searchsorted(seeds, lo + x))))
                done = lo + y
            k = to
    return out


def blocks(benchmark: DataFrame, min_words: int) -> Iterator[tuple[list, Index]]:
    """Blocks of items: a bounded number of characters is on the driver at a time."""
    ids, texts, size = [], [], 0
    for x in benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).toLocalIterator():
        if texts and size + len(x.text) > BLOCK_CHARS:
            yield ids, Index(texts, min_words)
            ids, texts, size = [], [], 0
        ids.append(x.item_id)
        texts.append(x.text)
        size += len(x.text)
    if texts:
        yield ids, Index(texts, min_words)


def seeded(docs: DataFrame, benchmark: DataFrame, min_words: int = 1) -> list[tuple]:
    """``(ids, index broadcast)`` of each block, with its rare 3-grams by counts over all documents."""
    spark = docs.sparkSession
    on_workers(spark)
    out = []
    for ids, index in blocks(benchmark, min_words):
        shared = spark.sparkContext.broadcast(index)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            total = np.zeros(len(index.grams), np.int64)
            for batch in batches:
                for part in split_batch(batch):
                    w = _words(part.column("text"))
                    first, gram = index.in_texts(w)
                    pairs = np.unique(text_of_words(w)[first] * len(index.grams) + gram) if len(first) else first
                    total += np.bincount(pairs % max(1, len(index.grams)), minlength=len(total))[: len(total)]
            used = np.flatnonzero(total)
            yield record(gram=used.astype(np.int64), n=total[used])

        documents = np.zeros(len(index.grams), np.int64)
        if len(index.grams):
            for gram, n in docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n")).collect():
                documents[gram] = n
        index.keep_rare(documents)
        out.append((ids, spark.sparkContext.broadcast(index)))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, score, start, end, n_seeds)``: code points of each aligned passage of a document and an item."""
    docs = with_text(docs, "doc_id")
    keys = [docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]
    schema = "doc_id {}, item_id {}, score double, start long, end long, n_seeds long".format(*keys)
    out = docs.sparkSession.createDataFrame([], schema)
    for ids, index in seeded(docs, benchmark):
        named = pa.array(ids, to_arrow_type(benchmark.schema["item_id"].dataType))
        out = out.union(map_batches(docs, partial(_rows, ids=named, index=index), schema))
    return out


def _rows(batch: pa.RecordBatch, ids: pa.Array, index) -> pa.RecordBatch | None:
    found = matches(batch, index.value)
    if not found:
        return None
    row, item, score, first, end, n = map(np.array, zip(*found, strict=True))
    w = words(batch.column("text"), NOT_ALNUM)  # lower case may change a word's length, but not which words there are
    points = Points(w.data)
    zero = points[w.text_at[row]]
    return record(doc_id=batch.column("doc_id").take(pa.array(row)), item_id=ids.take(pa.array(item)), score=np.round(score, 4), start=points[w.start[first]] - zero, end=points[w.end[end - 1]] - zero, n_seeds=n)


def decontaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_ITEM_WORDS) -> DataFrame:
    """The documents that hold no passage of an item of ``min_words`` or more. No shuffle: each task judges its own rows."""
    whole = docs.schema
    names = [f.name for f in whole.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.fields)
    out = docs
    for _, index in seeded(docs, benchmark, min_words):
        out = map_batches(out, partial(_clean, names=names, index=index), schema)
    return out


def _clean(batch: pa.RecordBatch, names: list[str], index) -> pa.RecordBatch:
    keep = np.ones(batch.num_rows, bool)
    keep[[x[0] for x in matches(batch, index.value)]] = False
    return batch.filter(pa.array(keep))


def op2_decontaminate(spark, sf_dir):
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
