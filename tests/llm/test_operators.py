"""Each operator against brute force, on the awkward rows and on tables without rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest


from volreg.llm import pii, quality_classifier, quality_rules, secret_scan, substring_dedup, toxicity, wordkernel
from volreg.llm.components import components
from volreg.llm.decontaminate import align, contaminated, decontaminated
from volreg.llm.jaccard_join import jaccard_components, one_of_each
from volreg.llm.packing import cuts, pack_documents, sequences
from volreg.llm.queries import ORACLE_SQL, QUERIES
from volreg.llm.token_output import code, decode, read_tokens, write_tokens
from volreg.llm.tokens import Encoder

from ..conftest import SMALL, same_rows
from .conftest import rows, texts

TABLE = [(r[0], r[1]) for r in rows()]
P = pytest.importorskip("public_tokenizers")
ASCII_WORDS = re.compile("[^\x20\x09-\x0d]+")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_on_awkward_and_empty_tables(spark, folder, name):
    assert QUERIES[name](spark, f"{folder}/none").count() == 0
    found = QUERIES[name](spark, folder).collect()
    if name not in ("op1_substring_dedup", "op2_decontaminate", "op5_packing"):
        assert Counter(r.doc_id for r in found) == Counter(d for d, _ in TABLE)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_twins(spark, duck, folder, name):
    same_rows(QUERIES[name], ORACLE_SQL[name], spark, duck)
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    same_rows(QUERIES[name], ORACLE_SQL[name], spark, con, folder)


def test_word_kernel():
    batch = ["a  b\nc", "", None, "\x0b x\x1cy é", "a b"]
    w = wordkernel.words(pa.array(batch))
    own = [ASCII_WORDS.findall(t or "") for t in batch]
    assert np.diff(w.word_at).tolist() == [len(x) for x in own]
    flat = [x for t in own for x in t]
    assert [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)] == flat
    assert len(set(w.hash.tolist())) == len(set(flat))
    assert [h for h, x in zip(w.hash.tolist(), flat, strict=True) if x == "b"][0] == w.hash[-1]


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in ASCII_WORDS.findall(text or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_components(table):
    ids = sorted({d for d, _ in table if d is not None})
    sets = defaultdict(list)
    for d, t in table:
        sets[d].append(shingles(t))
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(s and t and 100 * len(s & t) >= 80 * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_jaccard_join_is_exact(spark, docs):
    want = brute_components(TABLE)
    got = jaccard_components(docs).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert all(r.n_shingles == len(shingles(dict(TABLE)[r.doc_id])) for r in got)
    kept = {r.doc_id for r in one_of_each(docs).collect()}
    assert kept == {i for i, c in want.items() if i == c} | {None}


def test_jaccard_join_on_chains_and_hot_groups(spark):
    import random

    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(2000)]
    base, table = [r.choice(vocabulary) for _ in range(90)], []
    for _ in range(60):  # near copies, many of which are not near each other
        d = base[:]
        for _ in range(r.randrange(0, 8)):
            d[r.randrange(len(d))] = r.choice(vocabulary)
        table.append(d)
    step = [r.choice(vocabulary) for _ in range(80)]
    for _ in range(30):  # a chain
        table.append(step)
        step = step[:]
        step[r.randrange(80)] = r.choice(vocabulary)
        step[r.randrange(80)] = r.choice(vocabulary)
    passage = [r.choice(vocabulary) for _ in range(50)]
    table += [[r.choice(vocabulary) for _ in range(r.randrange(2, 30))] + passage for _ in range(50)]
    table += [base] * 20
    r.shuffle(table)
    table = [(i, " ".join(d)) for i, d in enumerate(table)]
    got = jaccard_components(spark.createDataFrame(table, "doc_id long, text string").repartition(4)).collect()
    assert {x.doc_id: x.component_id for x in got} == brute_components(table)


def test_jaccard_join_of_equal_sizes_at_the_bound(spark):
    def changed(words, new, *at):
        return [f"{new}{i}" if i in at else w for i, w in enumerate(words)]

    a, q = [f"w{i}" for i in range(94)], [f"q{i}" for i in range(50)]
    b, friend = changed(a, "b", 40, 60), changed(a, "f", 80)  # a and its friend are one component before b is met
    assert len(shingles(" ".join(a))) == len(shingles(" ".join(b))) == 90 and len(shingles(" ".join(a)) & shingles(" ".join(b))) == 80
    # of a's nine rarest shingles, all b's too, five are in a component with more members than a's
    others = [[*a[4:13], *q, f"d{i}"] for i in range(3)]
    fillers = [[*a[9:], *q, *(f"r{i}x{k}" for k in range(200))] for i in range(12)]
    table = [(i, " ".join(d)) for i, d in enumerate([*others, friend, a, b, *fillers])]
    want = brute_components(table)
    assert want[4] == want[5] == 3
    got = jaccard_components(spark.createDataFrame(table, "doc_id long, text string").repartition(4)).collect()
    assert {x.doc_id: x.component_id for x in got} == want


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100)], "a long, b long")
    assert {r.node: r.component for r in components(links).collect()} == {**dict.fromkeys(range(1, 61), 1), 100: 100, 101: 100}


def test_substring_dedup(spark, docs):
    runs = substring_dedup.duplicate_runs(docs).collect()
    whole = dict(TABLE)
    by = defaultdict(list)
    for r in runs:
        by[r.rank].append(r)
        assert r.kept_rank <= r.rank
    assert [(r.n_words, r.kept_rank) for r in by[10]] == [(4, 9)]  # a whole line, however short
    assert 1 not in by and 4 not in by and 15 not in by  # firsts and clean texts stay
    assert by[2] and by[3] and by[12]
    inside = whole[12][by[12][0].start : by[12][0].end]
    assert inside in whole[11] and len(inside.split()) > 40
    left = {r.doc_id: r.text for r in substring_dedup.without(docs, substring_dedup.duplicate_runs(docs)).collect()}
    assert left[1] == whole[1] and inside not in left[12] and left[12].startswith(whole[12][: by[12][0].start])


def test_substring_dedup_of_lines_and_of_runs_from_one_text(spark):
    from .conftest import words

    own = lambda i: " ".join(words(100 + i, 40, 10**9))
    line = "Licensed under the Apache License, Version 2.0."
    table = {i: f"{own(2 * i)}\n{line}\n{own(2 * i + 1)}" for i in range(3)}
    table[3] = f"{own(50)}\n{line}\n{own(51)}\n{line}\n"  # and once more in the same text
    parts = [" ".join(words(200 + i, 12, 10**9)) for i in range(5)]
    table |= {10 + i: f"{own(60 + i)} {x} {own(70 + i)}" for i, x in enumerate(parts)}
    table[20] = f"{own(80)} {' '.join(parts)} {own(81)}"  # each part is met in another text, no run of 24 words in any
    passage = words(300, 60, 10**9)
    table |= {30: f"{own(90)} {' '.join(passage)} {own(91)}", 31: f"{own(92)} {' '.join(passage)} {own(93)}", 29: f"{own(94)} {' '.join(passage[25:35])} {own(95)}"}
    d = spark.createDataFrame(list(table.items()), "doc_id long, text string").repartition(3)
    runs = substring_dedup.duplicate_runs(d)
    found = [(r.rank, table[r.rank][r.start : r.end]) for r in runs.orderBy("rank", "start").collect()]
    assert [f for f in found if f[0] < 31] == [(i, line[:-1]) for i in (1, 2, 3, 3)]
    assert [r for r, _ in found[4:]] == [31] and found[4][1] in " ".join(passage) and len(found[4][1].split()) > 45
    left = {r.doc_id: r.text for r in substring_dedup.without(d, runs).collect()}
    assert left[0] == table[0] and left[20] == table[20] and line[:-1] not in left[3]


def test_alignment():
    item = np.arange(10, dtype=np.uint64)
    assert align(item, np.arange(5, 30, dtype=np.uint64)) == (5.0, 5)
    edited = np.array([90, 0, 1, 2, 77, 4, 5, 6, 7, 88, 8, 9, 91], np.uint64)
    score, end = align(item, edited)  # one word changed, one put in: nine matches, two costs
    assert (score, end) == (8.0, 12)


def test_decontamination(spark, docs):
    item = texts()[4].split()[20:50]
    edited = item[:]
    edited[3], edited[17] = "changed", "words"
    del edited[9]
    bench = spark.createDataFrame([(1, " ".join(item).upper()), (2, " ".join(edited)), (3, "no such passage is in any text of these"), (4, None), (5, "of it")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in contaminated(docs, bench).collect()}
    assert set(got) == {(4, 1), (4, 2), (13, 5)}  # two words are reported, but no document goes for them
    assert got[4, 1].score == 1.0 and 0.6 < got[4, 2].score < 1
    assert dict(TABLE)[4][got[4, 1].start : got[4, 1].end] == " ".join(item)
    kept = decontaminated(docs, bench).collect()
    assert Counter(r.doc_id for r in kept) == Counter(d for d, _ in TABLE if d != 4)
    assert decontaminated(docs, bench.limit(0)).count() == len(TABLE)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_whole_texts(name):
    import random

    from tokenizers import Tokenizer

    r = random.Random(1)
    odd = ["".join(r.choice(" \n\t.'sab1é́<|>Z\x01\x1c ſ") for _ in range(r.randrange(1, 14))) for _ in range(800)]
    batch = [t for _, t in TABLE] + odd + ["<|endoftext|> x", "a  b   c ", "don't we'll"]
    plain = Tokenizer.from_file(P.path(name))
    want = [e.ids for e in plain.encode_batch([t or "" for t in batch], add_special_tokens=False)]
    encode = Encoder(P.path(name))
    assert [x.tolist() for x in encode(batch)] == want
    assert [x.tolist() for x in encode(batch)] == want  # from what it kept


def test_byte_coding_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (r.integers(0, 2**32, n, dtype=np.uint64) >> r.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
        control, data = code(v)
        assert decode(control, data, n).tolist() == v.tolist()
        assert len(control) == (n + 3) // 4 and len(data) == sum(max(1, (int(x).bit_length() + 7) // 8) for x in v)


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    files = write_tokens(docs, P.path("byte_bpe_50k.json"))
    got = sorted(read_tokens(files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 1, *range(2, 21)]
    at, whole = 0, dict(TABLE)
    for r in got:
        ids = plain.encode(whole[r.doc_id] or "", add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens) == (at, len(ids)) and np.frombuffer(r.ids, "<u4").tolist() == ids
        at += len(ids)
    ranks = [r.id for r in files.ranks.orderBy("rank").collect()]
    n = Counter(i for r in got for i in np.frombuffer(r.ids, "<u4").tolist())
    assert [n[i] for i in ranks] == sorted(n.values(), reverse=True)


@pytest.mark.parametrize("copies", [5, 1000])
def test_decontamination_of_repeated_edited_copies(spark, copies):
    item = [f"i{i}" for i in range(40)]
    edited = [f"e{i}" if i in (7, 15, 23, 31) else w for i, w in enumerate(item)]  # twelve of 38 3-grams are gone
    text = {0: " ".join(edited), 1: " ".join(item[:28])}  # the other is the first 70 %
    bench = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    for kind, t in text.items():
        table = [(i, f"x{i} y{i} {t} z{i}") for i in range(copies)]
        # each lost 3-gram is somewhere by chance
        table += [(10_000 + i, f"c{i} {' '.join(item[i : i + 3])} c{i}") for i in range(38) if " ".join(item[i : i + 3]) not in t and (kind == 0 or i % 2)]
        d = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
        assert {r.doc_id for r in contaminated(d, bench).collect()} == set(range(copies))
        assert {r.doc_id for r in decontaminated(d, bench).collect()} == {i for i, _ in table if i >= 10_000}


def test_decontamination_by_common_phrases_of_short_items(spark):
    bench = spark.createDataFrame([(1, "what is the name of"), (2, "who was the first man there"), (3, "one two three four five six seven eight nine ten")], "item_id long, text string")
    table = [(i, f"a{i} what is the b{i} was the first c{i}") for i in range(50)] + [(100, "so: What is the name of it"), (101, "one two three four five six"), (102, "one two three four other six seven eight nine end")]
    d = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    assert {(r.doc_id, r.item_id) for r in contaminated(d, bench).collect()} == {(100, 1), (102, 3)}
    assert {r.doc_id for r in decontaminated(d, bench).collect()} == {i for i, _ in table} - {100, 102}


def test_cuts():
    for n in range(1, 5000):
        pieces = cuts(n)
        assert sum(x for x, _ in pieces) == n and all(x * k <= 2048 for x, k in pieces)


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    found = pack_documents(docs, P.path("word_bpe_49k.json"), with_ids=True)
    pieces = found.collect()
    whole, per = dict(TABLE), defaultdict(list)
    for p in pieces:
        per[p.doc_id].append(p)
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
    for d, own in per.items():
        ids = plain.encode(whole[d] or "", add_special_tokens=False).ids + [1]
        times = Counter(x for x, _ in TABLE)[d]
        assert sum(p.length for p in own) == times * len(ids)
        assert all(np.frombuffer(p.ids, "<u4").tolist() == ids[p.start : p.start + p.length] and p.doc_tokens == len(ids) for p in own)
    filled = defaultdict(list)
    for p in pieces:
        filled[p.sequence_id].append((p.offset, p.length))
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert {r.sequence_id: len(r.ids) // 4 for r in sequences(found).collect()} == {s: sum(n for _, n in own) for s, own in filled.items()}
    assert sum(p.length for p in pieces) > 0.9 * 2048 * len(filled)


def test_packing_of_short_documents(spark):
    import random

    r = random.Random(7)
    for longest in (0, 29):  # texts without words, and documents of 1 to 30 ids
        docs = spark.createDataFrame([(i, " ".join(["the"] * r.randint(0, longest))) for i in range(12000)], "doc_id long, text string").repartition(3)
        filled, n = defaultdict(list), Counter()
        for p in pack_documents(docs, P.path("word_bpe_49k.json")).collect():
            filled[p.sequence_id].append((p.offset, p.length))
            n[p.doc_id] += p.length
            assert p.length == p.doc_tokens <= 30
        assert len(n) == 12000
        for own in filled.values():
            own.sort()
            assert own[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(own, own[1:])) and sum(own[-1]) <= 2048
        ids = sum(n.values())
        assert len(filled) <= ids / 2048 / 0.97 + 1


def test_secret_scan(spark, docs):
    got = {r.doc_id: r for r in secret_scan.secret_spans(docs, *secret_scan.by_source()).collect()}
    text = dict(TABLE)[16]
    spans = [s.split(":") for s in got[16].spans.split(",")]
    assert [k for k, _, _ in spans] == ["assign", "hex", "assign", "access"]
    assert text[int(spans[1][1]) : int(spans[1][2])] == "0123456789abcdef" * 2
    assert got[16].n_live == 4 and got[5].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = {r.doc_id: r for r in secret_scan.redact(docs, *secret_scan.by_source()).collect()}
    assert "0123456789abcdef" not in clean[16].text and "AKIA" not in clean[16].text and clean[16].text.startswith("Prose before. [SECRET]")
    assert clean[15].text == dict(TABLE)[15] and clean[5].text is None and clean[16].base == "y"
    copied = spark.createDataFrame([(i, 'token = "abcdefgh12345"', f"s{i}") for i in range(5)], "doc_id long, text string, source string").selectExpr("*", "'en' lang")
    assert {(r.n_live, r.n_example) for r in secret_scan.secret_spans(copied, *secret_scan.by_source()).collect()} == {(0, 1)}
    assert all("abcdefgh" in r.text for r in secret_scan.redact(copied, *secret_scan.by_source()).collect())


def test_quality_rules(spark, docs):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert all(not got[i].kept for i in (5, 6, 7, 8, 9, 13, 14)) and all(got[i].kept for i in (1, 3, 4, 11, 15, 19, 20))
    assert got[14].base_failed and not got[13].base_failed is None
    clean = {r.doc_id: r for r in quality_rules.clean_documents(docs).collect()}
    assert "Home |" not in clean[19].text and clean[20].text == dict(TABLE)[20].split("\n")[1] and clean[20].n_chars == len(clean[20].text)
    assert clean[4].rep == -4


def test_isotonic():
    curve = quality_classifier.isotonic(np.array([2, 0, 2, 2]), np.array([1, 0, 0, 2]))
    assert curve.tolist() == [0.25, 0.25, 0.25, 1.0]


@pytest.mark.parametrize(("op", "label", "floor"), [("op7_quality_classifier", "quality", 0.85), ("op8_toxicity", "toxic", 0.85)])
def test_held_out_accuracy(spark, duck, op, label, floor):
    known = dict(duck.execute(f"select doc_id, {label} from labels").fetchall())
    got = QUERIES[op](spark, SMALL).collect()
    assert all(0 <= r.score <= 1 for r in got)
    held = [r.predicted == known[r.doc_id] for r in got if r.held_out and r.doc_id in known]
    assert len(held) > 10 and sum(held) >= floor * len(held)


def test_held_out_labels_do_not_matter(spark, docs):
    from pyspark.sql import functions as F

    held = F.col("doc_id") % 2 == 0
    a = spark.createDataFrame([(i, int(i not in (13, 14)), int(i in (9, 17))) for i in texts()], "doc_id long, quality int, toxic int")
    b = a.withColumns({"quality": F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")), "toxic": F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))})
    for f in (quality_classifier.quality_scores, toxicity.toxicity_scores):
        one, two = (sorted((str(r.doc_id), r.score) for r in f(docs, x, held).collect()) for x in (a, b))
        assert one == two


def test_noisy_or_finds_the_sentence(spark):
    rows_, toxic = [], []
    for i in range(60):
        bad = i % 3 == 0
        rows_.append((i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(20)) + ". " + ("you idiot" if bad else "you friend") + " there. The end."))
        toxic.append((i, int(bad)))
    from pyspark.sql import functions as F

    d = spark.createDataFrame(rows_, "doc_id long, text string")
    got = toxicity.toxicity_scores(d, spark.createDataFrame(toxic, "doc_id long, toxic int"), F.col("doc_id") % 4 == 2).collect()
    for r in got:
        assert r.predicted == int(r.doc_id % 3 == 0)
        if r.predicted:
            assert rows_[r.doc_id][1][r.worst_start : r.worst_end] == "you idiot there"


def test_pii_base_spans_and_model(spark, docs):
    text = dict(TABLE)[17]
    spans = pii.base_spans(text)
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in spans] == [("email", "jo.doe@mail.example.com"), ("phone", "+44 20 7946 0958"), ("card", "4111 1111 1111 1111"), ("ip", "10.0.0.255")]
    assert pii.base_spans("9" * 9000) == [] and pii.base_spans("1.2.3." + "0" * 9000 + "7") == [(0, 1, 9007)]
    got = {r.doc_id: r for r in pii.pii_spans(docs).collect()}
    assert (got[17].n_email, got[17].n_ip, got[17].n_card, got[17].n_phone) == (1, 1, 1, 1) and got[18].n_email == 0
    assert got[1].spans == "" and got[15].spans == ""
    votes = np.array([[2, 2, 0, 2], [1, 0, 1, 1], [2, 0, 0, 2], [0, 0, 1, 1]])
    p, tables = pii.reliabilities(votes, np.array([50.0, 40, 30, 20]))
    assert p[0] > 0.9 and p[2] > 0.9 and p[1] < 0.1 and p[3] < 0.1 and np.allclose(tables.sum(2), 1)


def test_pipeline(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder)
        if name != "packing":
            assert docs.columns == before.columns
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {1, 2, 3, 4} <= kept["quality"] and not {5, 13, 14} & kept["quality"]
    assert 1 in kept["near_dup"] and not {2, 3} & kept["near_dup"]
    assert kept["leaks"] == kept["near_dup"] - {4} and kept["secrets"] == kept["leaks"] == kept["packing"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == kept["packing"]
