"""Line-first quality rules.

Every line of a text is judged by itself: lines that fail the punctuation, the
navigation or the boilerplate rule are removed, then a document that lost too large a
part of its characters is rejected. Counts over whole texts reject it as well.

Definitions. A word is a run of characters other than the six of ASCII white space.
Lines are parted by \\n; a line without a word is neither judged nor counted.

Cases. A null or empty text has no words and is rejected (too few words). Repeated rows
are judged alike. A table without rows gives one without rows. Columns besides
``doc_id`` and ``text`` are ignored, or handed on by ``clean_documents``. A null doc_id
is handed on as null.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, record, with_text
from .wordkernel import SPACE, inner_windows, per_text, text_of_words, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document that keeps less than this part of its lines' characters is rejected.
MIN_KEPT_PERCENT = 50
#: Punctuation rule: symbols (of the class below) for each 100 characters of a line.
MAX_SYMBOL_PERCENT = 8
#: Navigation rule: separators for each 100 words of a line.
MAX_SEPARATOR_PERCENT = 30

# Characters of the contract's symbol count, and the classes of the line rules.
SYMBOLS = "#*$%&|<>"
LINE_SYMBOLS = "#*$%&<>{}~^!"
SEPARATORS = "|»›•"
BOILERPLATE = "licensed under the|all rights reserved|terms of (use|service)|privacy policy|cookie policy|uses cookies|enable javascript|copyright (c|[0-9])|subscribe to our|click here to"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_boilerplate = re.compile(BOILERPLATE)
_ascii_words = re.compile("[^\x20\x09-\x0d]+")


def line_fails(line: str, words_in_line: int) -> str | None:
    """The rule that a line with words fails, or None."""
    symbols = sum(map(line.count, LINE_SYMBOLS))
    if symbols >= 3 and 100 * symbols > MAX_SYMBOL_PERCENT * len(line):
        return "punctuation"
    separators = sum(map(line.count, SEPARATORS))
    if separators >= 2 and 100 * separators > MAX_SEPARATOR_PERCENT * words_in_line:
        return "navigation"
    if words_in_line <= 30 and _boilerplate.search(line.lower()):
        return "boilerplate"
    return None


def judge(batch: pa.RecordBatch, text_out: bool) -> pa.RecordBatch:
    """Counts, verdict and the cleaned text of each row of a batch."""
    texts = batch.column("text")
    w = words(texts)
    n_words = np.diff(w.word_at)
    characters = per_text(((w.data & 0xC0) != 0x80) & ~SPACE[w.data], w.text_at)
    symbols = per_text(_SYMBOL[w.data], w.text_at)
    # words in repeated 3-word windows: equal windows of one text lie side by side when sorted
    h, first = inner_windows(w, 3)
    of = text_of_words(w)
    order = np.lexsort((h, of[first]))
    same = (h[order][1:] == h[order][:-1]) & (of[first][order][1:] == of[first][order][:-1])
    twice = np.zeros(len(h), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    covered = np.zeros(len(w.hash) + 2, bool)
    for i in range(3):
        covered[first[twice] + i] = True
    repeated = per_text(covered[: len(w.hash)], w.word_at)

    dup_lines, failed, kept_percent, cleaned = [], [], [], []
    for text in texts.to_pylist():
        seen, dups, fails, lost, total, good = set(), 0, 0, 0, 0, []
        for line in (text or "").split("\n"):
            n = len(_ascii_words.findall(line)) if line else 0
            if not n:
                good.append(line)
                continue
            dups += line in seen
            seen.add(line)
            total += len(line)
            if line_fails(line, n):
                fails += 1
                lost += len(line)
            else:
                good.append(line)
        dup_lines.append(dups)
        failed.append(fails)
        kept_percent.append(100 * (total - lost) // total if total else 0)
        if text_out:
            cleaned.append("\n".join(good))
    base = (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n_words)
    keep = ~base & (np.array(kept_percent, np.int64) >= MIN_KEPT_PERCENT)
    columns = {c: batch.column(c) for c in batch.schema.names if c != "text"}
    columns |= {"n_words": n_words, "word_chars": characters, "n_symbols": symbols, "n_dup_lines": np.array(dup_lines, np.int64), "n_repeat_words": repeated}
    columns |= {"base_failed": base, "kept": keep, "n_failed_lines": np.array(failed, np.int64), "kept_percent": np.array(kept_percent, np.int64)}
    return record(**columns, **({"cleaned": pa.array(cleaned, pa.string())} if text_out else {}))


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_failed_lines long, kept_percent long"


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row for each document: the counts, the rules' verdict, the failed lines."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(with_text(docs, "doc_id"), partial(judge, text_out=False), f"doc_id {kind}, {COUNTS}")


def clean_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with failed lines removed and the columns of ``docs``."""
    rest = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    judged = map_batches(with_text(docs, *(f"`{f.name}`" for f in rest)), partial(_passing, names=[f.name for f in rest]), f"{schema}, text string")
    if "n_chars" in docs.columns:
        judged = judged.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return judged.select(docs.columns)


def _passing(batch: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    judged = judge(batch.select(["text"]), text_out=True)
    keep = judged.column("kept")
    return record(**{n: batch.column(n).filter(keep) for n in names}, text=judged.column("cleaned").filter(keep))


def op6_quality_rules(spark, sf_dir):
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# Words are cut by the same six characters; a window of three words is repeated if the text
# has it twice, and every word in such a window counts once.
OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w),
t AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i+1], ws[i+2]) AS n FROM g),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i+1, i+2]) AS p FROM t WHERE n > 1) GROUP BY rid),
l AS (SELECT rid, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM (SELECT rid, string_split(text, chr(10)) AS ls FROM d)),
j AS (SELECT rid, line, length(line) AS c, row_number() OVER (PARTITION BY rid, line ORDER BY k) AS copy,
  len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
  length(regexp_replace(line, '[^#*$%&<>{}~^!]', '', 'g')) AS s, length(regexp_replace(line, '[^|»›•]', '', 'g')) AS p
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
f AS (SELECT *, (s >= 3 AND 100 * s > 8 * c) OR (p >= 2 AND 100 * p > 30 * n)
  OR (n <= 30 AND regexp_matches(lower(line), 'licensed under the|all rights reserved|terms of (use|service)|privacy policy|cookie policy|uses cookies|enable javascript|copyright (c|[0-9])|subscribe to our|click here to')) AS bad FROM j),
a AS (SELECT rid, count(*) FILTER (WHERE copy > 1) AS dups, count(*) FILTER (WHERE bad) AS bads,
  sum(c) AS total, coalesce(sum(c) FILTER (WHERE bad), 0) AS lost FROM f GROUP BY rid),
b AS (SELECT w.rid, d.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dups, 0)::BIGINT AS n_dup_lines,
  coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(bads, 0)::BIGINT AS n_failed_lines,
  coalesce(100 * (total - lost) // total, 0)::BIGINT AS kept_percent
  FROM w JOIN d ON d.rid = w.rid LEFT JOIN r ON r.rid = w.rid LEFT JOIN a ON a.rid = w.rid)
SELECT * EXCLUDE (rid), n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND kept_percent >= 50 AS kept FROM b
"""
