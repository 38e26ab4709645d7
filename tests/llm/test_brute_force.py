"""Operators that SQL cannot express against plain loops over small tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from volreg.llm import decontaminate, pii, quality_classifier, quality_rules, secret_scan, substring_dedup, toxicity, wordkernel
from volreg.llm.packing import pack_documents

from .conftest import rows, texts, words
from .test_operators import TABLE, P, brute_components, shingles

ALNUM = re.compile("[A-Za-z0-9\x80-\U0010ffff]+")


def lowered(text):
    return [m[0].lower() for m in ALNUM.finditer(text or "")]


# ---- substring dedup


def brute_spans(table, keys, min_words=24, reach=3):
    """(rank, start, end, n_words, kept_rank) of each span to remove."""
    found = defaultdict(list)
    for rank, text in set(table):
        if rank is None:
            continue
        place = [(m.start(), m.end()) for m in ALNUM.finditer(text or "")]
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), text[a:b]) for a, b in place]
        h = wordkernel.words(pa.array([text]), wordkernel.NOT_ALNUM, wordkernel.LOWER).hash
        assert len(h) == len(w)
        pair = [*wordkernel.windows(h, 2).tolist(), *h[-1:].tolist()]
        line = [i for i in range(len(w)) if i == 0 or "\n" in text[place[i - 1][1] : place[i][0]]]
        begins = [i for i in range(len(w)) if i in line or all(pair[i] < pair[j] for j in range(max(0, i - reach), i)) and all(pair[i] <= pair[j] for j in range(i + 1, min(len(w), i + reach + 1)))]
        ends = [*begins[1:], len(w)][: len(begins)]
        spans = set(zip(line, [*line[1:], len(w)], strict=False))
        for x in begins:
            spans |= {(x, y) for y in [min((e for e in ends if e >= x + min_words), default=0)] if y}
        for y in ends:
            spans |= {(x, y) for x in [max((b for b in begins if b <= y - min_words), default=-1)] if x >= 0}
        for x, y in spans:
            found[tuple(w[x:y])].append((rank, keys[rank, text], x, y, place[x][0], place[y - 1][1]))
    again = defaultdict(list)
    for own in found.values():
        first = min(own)
        for o in own:
            if o[:4] != first[:4]:
                again[o[:2]].append((*o[2:], first[0]))
    out = []
    for (rank, _), own in again.items():
        runs = []
        for x, y, a, b, kept in sorted(own):
            if runs and x <= runs[-1][1]:
                r = runs[-1]
                runs[-1] = (r[0], max(r[1], y), min(r[2], a), max(r[3], b), min(r[4], kept))
            else:
                runs.append((x, y, a, b, kept))
        out += [(rank, a, b, y - x, kept) for x, y, a, b, kept in runs]
    return sorted(out)


def test_substring_dedup(spark):
    r = random.Random(5)
    passage, line = " ".join(words(900, 60, 10**9)), "a line of fourteen words that every one of these six documents has in it"
    own = lambda i, n=30: " ".join(words(910 + i, n, 10**9))
    table = [(i, f"{own(i)}\n{line}\n{own(i + 20)}") for i in range(6)]
    table += [(10, passage), (11, "head " + passage), (11, "Y " + own(50, 60)), (12, f"{own(60)} {passage[40:480]} {own(61)}"), (None, passage), (13, None), (14, "Né 1é\n\n Né! 1é"), (15, "x"), (16, "X.")]
    table += [(30 + i, "\n".join(" ".join(r.choice("ab c1 dé e f".split()) for _ in range(r.randrange(0, 5))) for _ in range(r.randrange(0, 40)))) for i in range(25)]
    table += [(40, table[-1][1]), table[3]]
    d = spark.createDataFrame(table, "doc_id long, text string").withColumns({"spans": F.lit("s"), "key": F.lit("k"), "rank": F.lit(0)}).repartition(4)
    keys = {(x.doc_id, x.text): x.k for x in d.withColumn("k", substring_dedup._key()).collect()}
    runs = substring_dedup.duplicate_runs(d)
    got = [tuple(x)[:5] for x in runs.collect()]
    assert sorted(got) == brute_spans(table, keys)
    assert {(x[0], x[4]) for x in got if x[0] < 20} >= {*((i, 0) for i in range(1, 6)), (11, 10), (12, 10), (16, 15)}
    left = substring_dedup.without(d, runs).collect()
    assert len(left) == len(table) and all((x.spans, x.key, x.rank) == ("s", "k", 0) for x in left)
    cut = defaultdict(list)
    for x in runs.collect():
        cut[x.rank, x.key].append((x.start, x.end))
    for rank, text in set(table):
        want, at = "", 0
        for a, b in sorted(cut.get((rank, keys[rank, text]), [])):
            want, at = want + text[at:a], b
        want = None if text is None else want + text[at:]
        assert want in [x.text for x in left if x.doc_id == rank]
    assert [x.text for x in left if x.doc_id == 11 and x.text.startswith("Y")] == [table[8][1]]


# ---- decontamination


def brute_align(item, passage):
    best, end = 0.0, 0
    row = [0.0] * (len(passage) + 1)
    for w in item:
        new = [0.0]
        for j, v in enumerate(passage, 1):
            new.append(max(0.0, row[j - 1] + (1.0 if v == w else -0.5), row[j] - 0.5, new[j - 1] - 0.5))
        row = new
        if max(row) > best:
            best, end = max(row), row.index(max(row))
    return best, end


def brute_passages(item, text):
    """All passages, the best first, of an item in words: each part beside one is sought again."""
    parts, out = [(0, len(text))], []
    while parts:
        x, y = parts.pop()
        score, end = brute_align(item, text[x:y])
        if score < 0.5 * len(item) or not item:
            continue
        _, back = brute_align(item[::-1], text[x : x + end][::-1])
        a, b = x + end - back, x + end
        if sum(w in text[a:b] for w in set(item)) >= min(8, len(item)):
            out.append((a, b, score / len(item)))
        parts += [(x, a), (b, y)]
    return out


def test_every_passage_of_every_item(spark):
    r = random.Random(8)
    items = {i: words(700 + i, n, 10**9) for i, n in enumerate([40, 25, 12, 9, 8, 6, 4, 3, 2, 1])}
    docs = {}
    for i in range(40):
        parts = [words(800 + i, r.randrange(5, 40), 10**9)]
        for _ in range(r.randrange(0, 4)):
            item = items[r.randrange(len(items))][:]
            for _ in range(len(item) // 8 if r.random() < 0.5 else 0):
                k = r.randrange(len(item))
                item[k : k + 1] = r.choice([[], ["put"], ["put", "in"]])
            parts += [item, words(850 + 7 * i + len(parts), r.randrange(0, 30), 10**9)]
        docs[i] = sum(parts, [])
    docs[50] = items[1] + items[1] + ["x"] * 30 + items[1] * 5
    docs[51] = items[9] + items[8] + ["y"] + items[9]
    d = spark.createDataFrame([(i, ". ".join(w).upper()) for i, w in docs.items()], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = defaultdict(list)
    for x in decontaminate.contaminated(d, bench).collect():
        text = ". ".join(docs[x.doc_id]).upper()
        before = len(lowered(text[: x.start]))
        got[x.doc_id, x.item_id].append((before, before + len(lowered(text[x.start : x.end])), x.score))
    want = {(i, k): sorted((a, b, round(s, 4)) for a, b, s in p) for i, w in docs.items() for k, item in items.items() if (p := brute_passages(item, w))}
    assert {k: sorted(v) for k, v in got.items()} == want
    assert len(want[50, 1]) == 7 and len(want[51, 9]) == 2 and len(want[51, 8]) == 1
    kept = {x.doc_id for x in decontaminate.decontaminated(d, bench).collect()}
    assert kept == {i for i in docs if not any((i, k) in want for k in range(6))}


def test_rare_seeds_by_plain_quantiles():
    r = np.random.default_rng(2)
    items = [" ".join(f"w{x}" for x in r.integers(0, 12, n)) for n in (30, 3, 5, 18, 40, 1, 0)]
    index = decontaminate.Index(items)
    n = r.integers(0, 50, len(index.grams)) ** 2
    entries = [(int(i), int(p), int(n[g])) for g in range(len(index.grams)) for i, p in zip(index.item[index.at[g] : index.at[g + 1]], index.place[index.at[g] : index.at[g + 1]], strict=True)]
    want = set()
    for item in range(len(items)):
        own = [c for i, _, c in entries if i == item]
        if own:
            limit = max(4 * max(1, np.quantile(own, 0.25)), np.quantile(own, 0.9, method="higher"))
            want |= {(i, p) for i, p, c in entries if i == item and c <= limit}
    index.keep_rare(n)
    assert set(zip(index.item.tolist(), index.place.tolist(), strict=True)) == want and len(index.grams) == len(index.at) - 1


# ---- quality classifier


def plain_statistics(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    size, lines = len(text.encode()), text.count("\n") + 1
    share = lambda chars: sum(text.count(c) for c in chars) / max(1, size)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = max(1, len(w))
    return [
        math.log1p(len(w)), min(20, size / n) / 20, share("#*$%&<>{}~^=_\\"), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("0123456789"), share(".,;:"), share("|"), share("!"), len(set(w)) / n, (len(windows) - len(set(windows))) / n,
        math.log1p(len(w) / lines), max(Counter(w).values(), default=0) / n, sum(b > 127 for b in text.encode()) / max(1, size), sum(len(x.encode()) <= 3 for x in w) / n, share("@/()[]\"'+-`"), len(re.findall(r"[.!?]\n", text)) / lines,
    ]


def test_quality_scores(spark):
    r = random.Random(6)
    table = [(i, t or "") for i, t in texts().items() if i != 15] + [(100 + i, " ".join(r.choice(["Ab", "cd.", "e!", "ff\n", "g|", "12"]) for _ in range(r.randrange(3, 90)))) for i in range(120)]
    label = {i: int(t.count("!") * 20 < len(t) + r.randrange(30)) for i, t in table}
    d = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    held = F.col("doc_id") % 4 == 0
    got = {x.doc_id: x.score for x in quality_classifier.quality_scores(d, spark.createDataFrame(list(label.items()), "doc_id long, quality int"), held).collect()}
    fold = {x.doc_id: x.f for x in d.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(quality_classifier.FOLDS)).alias("f")).collect()}
    x = np.array([plain_statistics(t) for _, t in table])
    batch = quality_classifier.statistics(pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in table], "text": [t for _, t in table]}))
    assert np.allclose(x, np.stack([batch.column(c).to_numpy() for c in quality_classifier.STATISTICS], 1))
    train = np.array([i % 4 != 0 for i, _ in table])
    y, f = np.array([label[i] for i, _ in table]), np.array([fold[i] for i, _ in table])
    mean, deviation = x[train].mean(0), x[train].std(0)
    random_ = np.random.default_rng(quality_classifier.SEED)
    direction, phase = random_.normal(size=(x.shape[1], 256)) / 4.0, random_.uniform(0, 2 * np.pi, 256)
    z = np.hstack([np.ones((len(x), 1)), np.sqrt(2 / 256) * np.cos(np.clip((x - mean) / np.where(deviation > 1e-9, deviation, 1), -6, 6) @ direction + phase)])

    def weights(rows):
        penalty = np.diag([1e-9, *[1e-3 * rows.sum() + 0.1] * 256])
        return np.linalg.solve(z[rows].T @ z[rows] + penalty, z[rows].T @ y[rows])

    bin_ = lambda raw: np.clip(((raw + 0.25) / 1.5 * 1000).astype(int), 0, 999)
    n, p = np.zeros(1000), np.zeros(1000)
    for k in range(quality_classifier.FOLDS):
        b = bin_(z[train & (f == k)] @ weights(train & (f != k)))
        np.add.at(n, b, 1)
        np.add.at(p, b, y[train & (f == k)])
    used = np.flatnonzero(n)
    # the closest rising rates: the greatest of the least means of runs around each bin
    rate = [max(min(p[used[a : c + 1]].sum() / n[used[a : c + 1]].sum() for c in range(i, len(used))) for a in range(i + 1)) for i in range(len(used))]
    want = np.interp(np.arange(1000), used, rate)[bin_(z @ weights(train))]
    close = np.isclose([got[i] for i, _ in table], want, atol=1e-6)
    assert close.mean() > 0.97  # a raw score on a bin's border may fall on either side


# ---- personal data

# The patterns of the contract.
PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    def fits(k, m):
        digits = re.sub("[^0-9]", "", m)
        return [True, k == 1 and all(int(x) <= 255 for x in m.split(".")), 12 <= len(digits) <= 19 and pii.luhn(digits), 9 <= len(digits) <= 15][k]

    return sorted((m.start(), k, m.end()) for k, p in enumerate(PLAIN) for m in re.finditer(p, text) if fits(k, m[0]))


def test_base_spans_are_those_of_the_patterns():
    r = random.Random(2)
    parts = ["a", "b.", "@", "x@y.z", ".", "1", "25", "300", "1.2.3.4", " ", "-", "+", "+4", "(", ")", "é", "4111111111111111", "_%"]
    for _ in range(20000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(0, 14)))
        base = pii.base_spans(text)
        assert base == plain_spans(text)
        more = pii.further_spans(text, base)
        every = [(m.start(), 4, m.end()) for m in pii.NUMBER.finditer(text) if 7 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert more == [x for x in every if not any(a < x[2] and x[0] < b for a, _, b in base)]
        both = base + more
        assert pii.all_beside(both) == [any(o != s and (abs(o[0] - s[2]) <= 60 or abs(s[0] - o[2]) <= 60) for o in both) for s in both]


def test_recall_of_planted_personal_data(spark):
    r = random.Random(9)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card():
        d = digits(15)
        return next(" ".join((d + c)[k : k + 4] for k in range(0, 16, 4)) for c in "0123456789" if pii.luhn(d + c))

    make = {
        "email": lambda: f"{r.choice('abc')}{digits(3)}.x@mail{digits(2)}.example.org", "ip": lambda: ".".join(str(r.randrange(256)) for _ in range(4)), "card": card, "phone": lambda: f"+{r.randrange(1, 99)} {digits(3)} {digits(3)} {digits(4)}",
        "number": lambda: r.choice(["call ({}) {}-{}", "tel {}-{}-{}", "mobile {} {} {}"]).format(digits(3).replace("0", "1"), digits(3), digits(4)), "name": lambda: f"{r.choice(['Dr.', 'Mrs', 'Prof.'])} {r.choice(['Anna', 'Omar', 'Li'])[:9]} {r.choice(['Smith', 'Okafor', 'Weber'])}",
    }
    table, planted = [], []
    for i in range(400):
        text = " ".join(words(i, 20)) + " see "
        for kind in r.sample(sorted(make), r.randrange(0, 4)):
            value = make[kind]()
            shown = value.split(" ", 1)[1] if kind in ("number", "name") else value
            text += f"{'contact ' if kind == 'number' else ''}{value[: len(value) - len(shown)]}"
            planted.append((i, kind, len(text), len(text) + len(shown)))
            text += f"{shown} , {' '.join(words(1000 + i, 12))} then "
        table.append((i, text))
    got = {x.doc_id: set(x.spans.split(",")) for x in pii.pii_spans(spark.createDataFrame(table, "doc_id long, text string").repartition(4)).collect()}
    hit = Counter(k for i, k, a, b in planted if f"{k}:{a}:{b}" in got[i])
    n = Counter(k for _, k, _, _ in planted)
    assert all(hit[k] >= 0.9 * n[k] for k in make), (hit, n)
    clean = [i for i in range(400) if not any(p[0] == i for p in planted)]
    assert len(clean) > 50 and all(got[i] == {""} for i in clean)


# ---- very long texts


@pytest.mark.parametrize("unit", ["a", "9", "1.", "a@", "x@y.z ", "+1(", "1 ", "555 123 4567 "])
def test_personal_data_in_long_texts_takes_linear_time(unit):
    import time

    text = unit * (500_000 // len(unit))
    t = time.process_time()
    spans = pii.base_spans(text)
    more = pii.further_spans(text, spans)
    [pii.judge(text, s, near) for s, near in zip(spans + more, pii.all_beside(spans + more), strict=True)]
    assert time.process_time() - t < 20


def test_one_text_of_ten_megabytes(spark, tmp_path):
    from volreg.llm.queries import QUERIES

    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(5000)]
    long = " ".join(r.choice(vocabulary) for _ in range(1_800_000))
    assert len(long) > 10_000_000
    short = " ".join(words(77, 80, 10**9))
    item = " ".join(words(78, 30, 10**9))
    table = [(1, f"{long[:5_000_000]} {item} {long[5_000_000:]}"), (2, short), (3, short), (4, " ".join(words(79, 90)))]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in table], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 5)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in sorted(QUERIES):
        found = QUERIES[name](spark, str(tmp_path)).collect()
        assert name.startswith(("op1_", "op2_", "op5_")) or sorted(x.doc_id for x in found) == [1, 2, 3, 4]
        if name.startswith("op2_"):
            assert [(x.doc_id, x.item_id, x.score) for x in found] == [(1, 1, 1.0)]
        if name.startswith("op9_"):
            assert {x.doc_id: x.component_id for x in found} == {1: 1, 2: 2, 3: 2, 4: 4}


# ---- the pipeline


def brute_pipeline(table, items):
    """``(doc_id, text)`` that are left before packing; each stage as plain loops."""
    kept = []
    for i, text, lang, source in table:
        text = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", text)
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeated = len({p for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)})
        lines = [(x, len(re.findall("[^\x20\x09-\x0d]+", x))) for x in text.split("\n")]
        good = [x for x, n in lines if not n or not quality_rules.line_fails(x, n)]
        total = sum(len(x) for x, n in lines if n)
        share = 100 * sum(len(x) for x, n in lines if n and x in good) // total if total else 0
        if len(w) >= 50 and 100 * repeated <= 50 * len(w) and share >= 50:
            kept.append((i, "\n".join(good), lang, source))
    group = brute_components([(i, t) for i, t, _, _ in kept])
    seen, one = set(), []
    for x in sorted(kept, key=lambda x: (x[0] is not None, x[0] or 0)):
        if x[0] is None or group[x[0]] == x[0] and x[0] not in seen:
            seen.add(x[0])
            one.append(x)
    clean = [x for x in one if not any(brute_passages(lowered(t), lowered(x[1])) for t in items if len(lowered(t)) >= 5)]
    held, spans = defaultdict(set), {}
    for k, (i, t, _, source) in enumerate(clean):
        own = [(m.start(), 0, m.end(), m[2]) for m in re.finditer(secret_scan.ASSIGN, t) if len(m[2]) >= 6]
        own += [(m.start(), 1, m.end(), m[0]) for m in re.finditer(secret_scan.ACCESS, t) if len(m[0]) >= 20] + [(m.start(), 2, m.end(), m[0]) for m in re.finditer(secret_scan.HEX, t) if len(m[0]) >= 24]
        mixed = [(m.start(), 3, m.end(), m[0]) for m in re.finditer(secret_scan.MIXED, t) if len(m[0]) >= 24 and all(re.search(c, m[0]) for c in ("[0-9]", "[a-z]", "[A-Z]"))]
        spans[k] = sorted(own + [x for x in mixed if not any(a < x[2] and x[0] < b for a, _, b, _ in own)])
        for x in spans[k]:
            held[x[3]].add((source or "", str(i or "")))
    out = []
    for k, (i, t, _, _) in enumerate(clean):
        new, at = "", 0
        for a, kind, b, v in spans[k]:
            owners = len({o for o, _ in held[v]})
            if owners <= (2 if kind < 3 else 1) and len(held[v]) <= 10:
                new += t[at:a] + "[SECRET]" if a >= at else ""
                at = max(at, b)
        out.append((i, new + t[at:]))
    return out


def test_pipeline(spark, folder):
    import corpus_pipeline
    from tokenizers import Tokenizer

    items = [x.text for x in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if x.text]
    want = brute_pipeline([(x[0], x[1], x[2], x[3]) for x in rows()], items)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    key = lambda x: (str(x[0]), x[1])
    assert sorted(((x.doc_id, x.text) for x in docs.collect()), key=key) == sorted(want, key=key)
    assert any("[SECRET]" in t for _, t in want) and 2 < len(want) < len(rows())
    plain = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: [*plain.encode(t, add_special_tokens=False).ids, 1] for i, t in want}
    pieces = corpus_pipeline.run(spark, folder).collect()
    per, filled = defaultdict(list), defaultdict(list)
    for p in pieces:
        per[p.doc_id].append(p)
        filled[p.sequence_id].append((p.offset, p.length))
    assert set(per) == set(ids)
    for i, own in per.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids[i])) and zlib.crc32(np.array(ids[i][at : at + p.length], "<u4").tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids[i])
    for own in filled.values():
        own.sort()
        assert own[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 2048


def test_packing_over_many_tasks(spark, monkeypatch):
    from volreg.llm import packing

    monkeypatch.setattr(packing, "POOL", 3)
    docs = spark.createDataFrame([(i, " ".join(words(i, 1 + i * 37 % 1500))) for i in range(300)] + [(None, "x y"), (2**62 + 1, "z")], "doc_id long, text string").repartition(20)
    got = pack_documents(docs, P.path("word_bpe_49k.json")).collect()
    assert {x.doc_id for x in got} == {*range(300), None, 2**62 + 1}
    filled = defaultdict(list)
    for x in got:
        filled[x.sequence_id].append((x.offset, x.length))
    for own in filled.values():
        own.sort()
        assert own[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 2048
    assert sum(x.length for x in got) > 0.93 * 2048 * len(filled)
