"""Substring dedup by hashing units of lines.

A text is cut into units at line breaks and, inside lines, before words whose hash is
the least of their neighbourhood, so a passage that begins in the middle of a line is
cut alike wherever it stands (whole lines alone would miss it). Units are normalised:
their lower-cased letters and digits count, what stands between them does not. Hashed are
whole lines with a word, however short, and the runs of neighbouring units that have just
``MIN_WORDS`` words or more, counted from each unit on and back from each, so that they
cover every passage of so many words up to its first and last unit, and each is met whole
in one earlier text. Digests are grouped over the corpus; the occurrence of the earliest
rank (then the earliest place) stays, every other one is a duplicate and is removed.
Duplicates that touch are one span; spans keep their offsets in the original text. A
repeated paragraph goes line by line.

Cases. Null and empty texts have no units. Rows with equal rank and text are one text:
their equal units at equal places are one occurrence and all stay. Rows with equal rank
and different texts are told apart by the hash of the text, the smaller first, and each
loses its own spans only. A null rank takes no part. Tables without rows give none.
Columns besides those named are ignored, and handed on by ``without``.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, record, stored, with_text
from .wordkernel import LOWER, NOT_ALNUM, Points, mix, spans_hash, text_of_words, windows, words

#: Words of a run of units that is no whole line, at least.
MIN_WORDS = 24
#: A word begins a unit if its hash is the least of so many words on each side.
REACH = 3


def units(batch: pa.RecordBatch, min_words: int = MIN_WORDS) -> pa.RecordBatch:
    """Digest, words and code points of each line and each least run of units of each text."""
    w = words(batch.column("text"), NOT_ALNUM, LOWER)
    n = len(w.hash)
    of = text_of_words(w)
    pair = np.append(windows(w.hash, 2), w.hash[n - 1 :]) if n else w.hash
    last = w.word_at[1:][np.diff(w.word_at) > 0] - 1
    pair[last] = w.hash[last]  # whatever text comes next in the batch
    begins = np.ones(n, bool)
    for i in range(1, REACH + 1):
        if n > i:
            same = of[i:] == of[:-i]
            begins[i:] &= ~same | (pair[i:] < pair[:-i])
            begins[:-i] &= ~same | (pair[:-i] <= pair[i:])
    begins[w.word_at[:-1][np.diff(w.word_at) > 0]] = True
    breaks = np.flatnonzero(w.data == 10)
    line_begins = np.append(np.ones(min(n, 1), bool), np.searchsorted(breaks, w.start[1:]) > np.searchsorted(breaks, w.end[:-1]))
    line_begins[w.word_at[:-1][np.diff(w.word_at) > 0]] = True
    begins |= line_begins
    unit, line = np.flatnonzero(begins), np.flatnonzero(line_begins)
    end, line_end = np.append(unit[1:], n)[: len(unit)], np.append(line[1:], n)[: len(line)]
    on = np.searchsorted(end, unit + min_words)  # the first unit that ends so many words on
    a, z = np.flatnonzero(on < len(unit)), on[on < len(unit)]
    back = np.searchsorted(unit, end - min_words, "right") - 1
    a, z = np.append(a, back[back >= 0]), np.append(z, np.flatnonzero(back >= 0))
    one_text = of[unit[a]] == of[unit[z]]
    a, z = unit[a[one_text]], end[z[one_text]]
    both = np.unique(np.append(a, line) * (n + 1) + np.append(z, line_end))
    first, last = both // (n + 1), both % (n + 1)
    digest = mix(spans_hash(w.hash, first, last) + (last - first).astype(np.uint64))
    points = Points(w.data)
    text = of[first]
    zero, word_zero = points[w.text_at[text]], w.word_at[text]
    start, end = points[w.start[first]] - zero, points[w.end[last - 1]] - zero
    return record(
        digest=digest.view(np.int64), rank=batch.column("rank").take(pa.array(text)), key=batch.column("key").take(pa.array(text)),
        words=((first - word_zero) << 32 | (last - word_zero)).astype(np.int64), span=(start << 32 | end).astype(np.int64))


def _key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def duplicate_runs(docs: DataFrame, rank: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """``(rank, start, end, n_words, kept_rank, key)``: the code points of each span to remove, the earliest rank that keeps of it, the hash of the text where ranks repeat (else null)."""
    named = docs.select(F.col(rank).cast("long").alias("rank"), F.col("text")).where("rank is not null")
    repeated = not named.groupBy("rank").count().where("count > 1").isEmpty()
    ranked = with_text(named, "rank", (_key() if repeated else F.lit(None).cast("long")).alias("key"))
    each = map_batches(ranked, partial(units, min_words=min_words), "digest long, rank long, key long, words long, span long")
    firsts = each.groupBy("digest").agg(F.min(F.struct("rank", "key", "words")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # stored, so that the join's partition of a line that very many texts hold can be split
    firsts = stored(firsts, "firsts")
    again = each.join(firsts, "digest").where("rank <> first.rank or not (key <=> first.key) or words <> first.words")
    again = again.selectExpr("rank", "key", "cast(words >> 32 as int) w0", "cast(words & 4294967295 as int) w1", "cast(span >> 32 as int) start", "cast(span & 4294967295 as int) end", "first.rank kept_rank").distinct()
    # each is a duplicate by itself; those that overlap or touch are one span; a partition holds one text's
    order = Window.partitionBy("rank", "key").orderBy("w0", "w1", "start", "end")
    runs = again.withColumn("new", F.coalesce(F.col("w0") > F.max("w1").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(order))
    found = runs.groupBy("rank", "key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("w1") - F.min("w0")).alias("n_words"), F.min("kept_rank").alias("kept_rank"))
    return found.select("rank", "start", "end", "n_words", "kept_rank", "key")


def without(docs: DataFrame, runs: DataFrame, rank: str = "doc_id") -> DataFrame:
    """``docs`` with the runs cut out of their texts; a row has the runs of its rank and, where they name it, its text's hash."""
    spans = runs.groupBy("rank", F.col("key").alias("of")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"), F.col(rank).cast("long").alias("rank"), _key().alias("key"))
    text = F.col("doc.text")
    cut = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("text")),
                      lambda a, x: F.struct(x["end"].alias("at"), F.concat(a["text"], F.substring(text, a["at"] + 1, x["start"] - a["at"])).alias("text")),
                      lambda a: F.concat(a["text"], F.substring(text, a["at"] + 1, F.length(text))))
    new = F.when(F.col("spans").isNull(), text).otherwise(cut)
    own = (rows["rank"] == spans["rank"]) & (spans["of"].isNull() | (spans["of"] == rows["key"]))
    return rows.join(spans, own, "left").select(*((new if c == "text" else F.col("doc")[c]).alias(c) for c in docs.columns))


def op1_substring_dedup(spark, sf_dir):
    return duplicate_runs(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("key").withColumnsRenamed({"rank": "doc_id", "kept_rank": "kept_doc_id"})
