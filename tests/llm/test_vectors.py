"""Hard negatives, top-k search and product codes against plain loops, on tables with awkward rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from volreg.llm import code_compression, hard_negatives, topk_search
from volreg.llm.vectors import first_of, matrix

NAMES = "vec_id long, embedding array<double>, label int, row long, block long, rank int, score long, q string, v string, n int, g int, code string"


def rows(n=400, width=12, seed=7):
    """Vectors around a few middles, many of them equal, and every awkward one."""
    r = np.random.default_rng(seed)
    middles = r.normal(size=(5, width))
    out = []
    for i in range(n):
        label = int(r.integers(5))
        x = middles[label] + 0.3 * r.normal(size=width)
        x /= np.linalg.norm(x)
        if i % 3 == 0:  # a third of all rows are one vector
            x, label = middles[0] / np.linalg.norm(middles[0]), 0
        out.append((i, [float(y) for y in x], None if i % 17 == 5 else label))
    out += [(100, out[100][1], out[100][2]), (50, out[50][1], 3), (None, out[1][1], 1), (n, None, 1), (n + 1, [1.0, None], 2), (n + 2, [math.nan] * width, 2), (n + 3, [math.inf] + [0.0] * (width - 1), 2)]
    out += [(n + 50, [], 2), (n + 100, [0.5, -0.5, 0.25], 1), (n + 101, [0.1] * (width + 3), 1), (n + 102, [1e300] * width, 1), (n + 103, [0.0] * width, 0), (n + 200, [-0.0] * width, 0), (-100, out[7][1], out[7][2])]
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(*x, 1, 2, 3, 4, "q", "v", 5, 6, "c") for x in rows()], NAMES)


def whole(scale, labelled=False, with_null_ids=False):
    """(vec_id, label, integers) of the rows that take part, as long as the longest."""
    out = []
    for i, x, label in rows():
        if (i is None and not with_null_ids) or x is None or any(y is None or not math.isfinite(y) for y in x) or (labelled and label is None):
            continue
        v = [math.floor(scale * y) for y in x]
        if sum(y * y for y in v) < 2**60:
            out.append((i, label, v))
    width = max(len(v) for _, _, v in out)
    return [(i, label, v + [0] * (width - len(v))) for i, label, v in out]


def product(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("parts", [1, 40])
def test_top_k_as_brute_force(vectors, parts):
    all_ = whole(1024)
    want = []
    for at, (i, _, v) in enumerate(all_):
        if i % 50 == 0:
            best = sorted((-product(v, w), j) for other, (j, _, w) in enumerate(all_) if other != at)[:10]
            want += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    assert got(topk_search.top_k(vectors.repartition(parts), F.col("vec_id") % 50 == 0)) == sorted(want)


def test_top_k_of_few_rows_and_large_numbers(spark, vectors):
    few = vectors.where("vec_id in (0, 1, 2)")
    assert [r[1:3] for r in got(topk_search.top_k(few, F.col("vec_id") == 0))] == [(1, 1), (2, 2)] or len(got(topk_search.top_k(few, F.col("vec_id") == 0))) == 2
    assert got(topk_search.top_k(vectors.where("vec_id = 0"), F.col("vec_id") == 0)) == []
    # sums beyond what floats hold
    big = [(i, [float((i * 7919 + d * 104729) % 2**26) for d in range(8)], 0) for i in range(60)]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>, label int").repartition(3)
    ints = {i: [int(y) for y in x] for i, x, _ in big}
    want = []
    for i in (0, 30):
        best = sorted((-product(ints[i], ints[j]), j) for j in ints if j != i)[:4]
        want += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    assert got(topk_search.top_k(df, F.col("vec_id") % 30 == 0, k=4, scale=1)) == want


@pytest.mark.parametrize("parts", [1, 40])
def test_hard_negatives_as_brute_force(vectors, parts):
    all_ = whole(256, labelled=True)
    want = []
    for at, (i, label, v) in enumerate(all_):
        if i % 10:
            continue
        scored = sorted((-product(v, w), j, other_label) for other, (j, other_label, w) in enumerate(all_) if other != at)
        for s, j, _ in [x for x in scored if x[2] == label][:5]:
            hard = [(t, k) for t, k, other_label in scored if other_label != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
            want += [(i, j, rank, k, -s, -t) for rank, (t, k) in enumerate(hard, 1)]
    assert want
    assert got(hard_negatives.hard_negatives(vectors.repartition(parts), F.col("vec_id") % 10 == 0, F.col("label"))) == sorted(want)


def test_other_numbers_of_positives_and_negatives(vectors):
    few = got(hard_negatives.hard_negatives(vectors, F.col("vec_id") % 10 == 0, F.col("label"), positives=2, negatives=1))
    many = got(hard_negatives.hard_negatives(vectors, F.col("vec_id") % 10 == 0, F.col("label")))
    assert few and set(few) <= set(many) and all(r[2] == 1 for r in few)


def codes(all_, entries=256, parts=4, rounds=4):
    all_ = [(i, label, v + [0] * (-len(v) % parts)) for i, label, v in all_]
    w = len(all_[0][2]) // parts
    start = sorted((i, v) for i, _, v in all_ if i is not None)[:entries]
    books = [[v[p * w : (p + 1) * w] for _, v in start] for p in range(parts)]

    def near(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, _, v in all_:
                members.setdefault(near(v[p * w : (p + 1) * w], books[p])[0], []).append(v[p * w : (p + 1) * w])
            books[p] = [[sum(c) // len(members[e]) for c in zip(*members[e], strict=True)] if e in members else b for e, b in enumerate(books[p])]
    out, of = [], {}
    for i, label, v in all_:
        found = [near(v[p * w : (p + 1) * w], books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found)))
        of[label] = of.get(label, 0) + out[-1][3]
    digest = hashlib.sha256(",".join(str(y) for b in books for c in b for y in c).encode()).hexdigest()
    return [(i, code, error, of[label], digest) for i, label, code, error in out]


@pytest.mark.parametrize("parts", [1, 7])
def test_codes_as_brute_force(vectors, parts):
    want = codes(whole(1024, with_null_ids=True))
    assert sorted(map(repr, got_any(code_compression.compressed(vectors.repartition(parts))))) == sorted(map(repr, want))


def got_any(df):
    return [tuple(r) for r in df.collect()]


def test_nearest_keeps_ties_and_large_numbers():
    r = np.random.default_rng(1)
    for top in (3, 1000, 2**20, 2**29):
        x, book = r.integers(-top, top, (300, 6)), r.integers(-top, top, (50, 6))
        book[20:25] = book[3]
        d = ((x[:, None, :].astype(object) - book[None].astype(object)) ** 2).sum(axis=2)
        at, s = code_compression.nearest(x, book)
        assert at.tolist() == [row.tolist().index(min(row)) for row in d] and s.tolist() == [min(row) for row in d]


def test_empty_tables(spark):
    none = spark.createDataFrame([], NAMES)
    assert got(topk_search.top_k(none, F.col("vec_id") % 50 == 0)) == []
    assert got(hard_negatives.hard_negatives(none, F.col("vec_id") % 10 == 0, F.col("label"))) == []
    assert got(code_compression.compressed(none)) == []
    no_id = spark.createDataFrame([(None, [1.0] * 4, None)], "vec_id long, embedding array<float>, label int")
    assert got(topk_search.top_k(no_id, F.col("vec_id") % 50 == 0)) == []
    assert got_any(code_compression.compressed(no_id))[0][:3] == (None, "00000000", 0)


def test_first_of_groups():
    group, score, ids = np.array([1, 0, 1, 1]), np.array([5, 1, 7, 7]), np.array([1, 2, 9, 3])
    assert first_of(group, score, ids, 2).tolist() == [1, 3, 2]


def test_short_lists_are_followed_by_zeros():
    import pyarrow as pa

    assert matrix(pa.array([[1, 2], [], [3]], pa.list_(pa.int64()))).tolist() == [[1, 2], [0, 0], [3, 0]]


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_topk_search", "op13_code_compression"])
def test_same_rows_as_sql(spark, duck, name):
    from tests.conftest import same_rows
    from volreg.llm import queries

    same_rows(queries.QUERIES[name], queries.ORACLE_SQL[name], spark, duck)


def test_copies_of_queries_are_never_broadcast(vectors, monkeypatch):
    from volreg.llm import vectors as shared

    want = got(topk_search.top_k(vectors, F.col("vec_id") % 100 == 0))
    plans, stored = [], shared.stored
    monkeypatch.setattr(shared, "stored", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or stored(df, name))
    monkeypatch.setattr(shared, "HELD", 0.002)  # shares of two queries
    assert got(topk_search.top_k(vectors, F.col("vec_id") % 100 == 0)) == want
    assert got(hard_negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0, F.col("label")))
    met = [plan for name, plan in plans if name == "passed"]
    assert len(met) >= 3 and not any("BroadcastExchange" in plan for plan in met)
