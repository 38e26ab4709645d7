"""Documents of equal doc_id, and the parts of fits, against plain loops."""

import random

import numpy as np
import pyarrow as pa
import pytest

from volreg.llm import toxicity, wordkernel
from volreg.llm.jaccard_join import jaccard_components, one_of_each

from .conftest import words
from .test_operators import brute_components, shingles


def test_jaccard_join_of_equal_doc_ids(spark):
    a, b = (" ".join(words(s, 40, 10**9)) for s in (500, 501))
    table = [(5, a), (5, b), (1, a), (3, b), (7, None), (7, " ".join(words(502, 30, 10**9))), (None, a), (9, a[: len(a) // 2]), (9, a[: len(a) // 2]), (None, None)]
    d = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    got = jaccard_components(d).collect()
    want = brute_components(table)
    assert want == {1: 1, 3: 1, 5: 1, 7: 7, 9: 9}
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == sorted((str(i), len(shingles(t)), want.get(i)) for i, t in table)
    kept = one_of_each(d).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "7", "9", "None", "None"]


def test_words_over_steps(monkeypatch):
    r = random.Random(1)
    texts = ["".join(r.choice(" \nabcdé") for _ in range(r.randrange(0, 60))) for _ in range(200)] + ["", None, "x" * 50]
    whole = wordkernel.words(pa.array(texts))
    runs = wordkernel.spans_hash(whole.hash, np.arange(0, 90), np.arange(0, 90) + np.arange(90) % 40)
    monkeypatch.setattr(wordkernel, "_STEP", 7)
    wordkernel._powers.cache_clear()
    try:
        assert wordkernel.words(pa.array(texts)).hash.tolist() == whole.hash.tolist()
        assert wordkernel.spans_hash(whole.hash, np.arange(0, 90), np.arange(0, 90) + np.arange(90) % 40).tolist() == runs.tolist()
    finally:
        wordkernel._powers.cache_clear()
    points = wordkernel.Points(whole.data)
    text = bytes(whole.data).decode()
    assert all(points[np.array([len(text[:i].encode())])][0] == i for i in range(0, len(text), 13))


def test_noisy_or_likelihood_and_gradient():
    r = np.random.default_rng(3)
    toxic, rows = r.integers(0, 2, 12), []
    for d in range(12):
        for s in range(r.integers(0, 4)):
            rows += [(d, s, w) for w in sorted(r.choice(6, r.integers(1, 4), replace=False).tolist())]
    of, sentence, word = (np.array(c) for c in zip(*rows, strict=True))
    x = r.normal(size=8)

    def plain(x):
        total = 0.0
        for d in range(12):
            none = 1 - 1 / (1 + np.exp(-x[-1]))
            for s in {s for a, s, _ in rows if a == d}:
                none *= 1 - 1 / (1 + np.exp(-sum(x[w] for a, b, w in rows if (a, b) == (d, s)) - x[-2]))
            total += np.log(1 - none if toxic[d] else none)
        return total

    got = toxicity.likelihood(toxic, of, sentence, word, x)
    assert np.isclose(got[0], plain(x))
    slope = [(plain(x + h) - plain(x - h)) / 2e-6 for h in np.eye(8) * 1e-6]
    assert np.allclose(got[1:], slope, atol=1e-5)
    # parts of the documents add up to the whole
    half = of < 6
    parts = toxicity.likelihood(toxic[:6], of[half], sentence[half], word[half], x) + toxicity.likelihood(toxic[6:], of[~half] - 6, sentence[~half], word[~half], x)
    assert np.allclose(parts, got)


def test_least_point_of_a_bowl():
    r = np.random.default_rng(4)
    a = r.normal(size=(20, 6))
    h, b = a.T @ a + 0.1 * np.eye(6), r.normal(size=6)
    x = toxicity.least(lambda x: (x @ h @ x / 2 - b @ x, h @ x - b), np.zeros(6))
    assert np.allclose(x, np.linalg.solve(h, b), atol=0.02)


@pytest.mark.parametrize("kind", ["int", "string", "long"])
def test_item_ids_of_any_type(spark, kind):
    from volreg.llm.decontaminate import contaminated

    passage = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"before {passage} after"), (2, "other words here"), (None, passage)], "doc_id int, text string")
    items = spark.sql(f"select cast(x as {kind}) as item_id, text from values (7, '{passage}'), (null, '{passage}'), (8, null) as t(x, text)")
    got = contaminated(docs, items)
    assert dict(got.dtypes)["item_id"] == dict(items.dtypes)["item_id"]
    assert sorted(map(repr, {(r.doc_id, r.item_id) for r in got.collect()})) == sorted(map(repr, [(d, i) for d in (1, None) for i in (7 if kind != "string" else "7", None)]))
