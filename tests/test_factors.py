"""QR, truncated SVD, topics and searches against NumPy."""

import random

import numpy as np
import pytest

from docweave.functions.text import STOP_WORDS
from docweave.operators import factors as X
from docweave.plans import factors as plans

SF = "/root/testdata/sf0.001"


def dense(spark, m, parts=5):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "id long, v array<double>").repartition(parts)


def array(df, width):
    rows = df.orderBy("id").collect()
    return np.array([r.v for r in rows]).reshape(len(rows), width)


def entries(spark, m):
    return spark.createDataFrame([(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1]) if m[i, j]], "row long, col long, value double").repartition(5)


@pytest.mark.parametrize("condition", [1.0, 1e12])
def test_tall_skinny_qr(spark, monkeypatch, condition):
    monkeypatch.setattr(X, "FAN", 2)  # a tree of several levels
    rng = np.random.default_rng(1)
    a = rng.standard_normal((500, 6)) @ np.diag(np.geomspace(1, 1 / condition, 6)) @ rng.standard_normal((6, 6))
    q, r = X.tall_skinny_qr(dense(spark, a, 9), 6)
    q = array(q, 6)
    assert np.abs(q.T @ q - np.eye(6)).max() < 1e-10
    assert np.abs(q @ r - a).max() < 1e-10 * np.abs(a).max() and np.abs(np.tril(r, -1)).max() == 0
    if condition == 1.0:
        want = np.linalg.qr(a, mode="r")
        assert np.abs(r - want * np.sign(np.diag(want))[:, None]).max() < 1e-9


def test_qr_of_dependent_columns_and_few_rows(spark):
    rng = np.random.default_rng(2)
    b = rng.standard_normal((80, 2))
    a = np.column_stack([b[:, 0], 2 * b[:, 0], b[:, 1], b[:, 0] - b[:, 1], np.zeros(80)])
    q, r = X.tall_skinny_qr(dense(spark, a), 5)
    q = array(q, 5)
    assert np.abs(q @ r - a).max() < 1e-10 and np.abs(q.T @ q - np.diag([1, 0, 1, 0, 0])).max() < 1e-10
    short = rng.standard_normal((2, 4))
    q, r = X.tall_skinny_qr(dense(spark, short), 4)
    assert np.abs(array(q, 4) @ r - short).max() < 1e-10
    q, r = X.tall_skinny_qr(dense(spark, a).limit(0), 5)
    assert q.count() == 0 and not r.any()


@pytest.mark.parametrize("shape", [(120, 70), (40, 200)])
def test_truncated_svd_equals_numpy(spark, shape):
    rng = np.random.default_rng(3)
    u, _ = np.linalg.qr(rng.standard_normal((shape[0], 30)))
    v, _ = np.linalg.qr(rng.standard_normal((shape[1], 30)))
    a = u @ np.diag(np.concatenate([[40, 30, 20, 15, 10], np.linspace(4, 0.1, 25)])) @ v.T
    found = X.truncated_svd(entries(spark, a), 5, tolerance=1e-13)
    want_u, want_s, want_v = np.linalg.svd(a)
    left, right = array(found.left, 5), array(found.right, 5)
    assert np.abs(found.values - want_s[:5]).max() < 1e-9
    for got, want in ((left, want_u[:, :5]), (right, want_v[:5].T)):
        cosines = np.linalg.svd(got.T @ want, compute_uv=False)
        assert np.sqrt(np.maximum(0, 1 - cosines.min() ** 2)) < 1e-6  # sine of the largest angle between the subspaces
        assert np.abs(got.T @ got - np.eye(5)).max() < 1e-10
    assert np.abs(left @ np.diag(found.values) @ right.T - want_u[:, :5] @ np.diag(want_s[:5]) @ want_v[:5]).max() < 1e-6
    assert (right[np.abs(right).argmax(axis=0), range(5)] > 0).all()


def test_svd_of_low_rank_repeated_and_no_entries(spark):
    e = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 2.0), ("b", "y", 4.0), ("c", "x", 0.0)], "row string, col string, value double")
    found = X.truncated_svd(e, 5)
    assert np.allclose(found.values, [4, 3]) and found.left.count() == 2
    assert len(X.truncated_svd(e.limit(0), 3).values) == 0
    assert X.topics(e.limit(0), 3).count() == 0 and X.svd_search(e.limit(0), X.truncated_svd(e.limit(0), 2), [1.0], 3).count() == 0
    assert len(X.dense_svd(dense(spark, np.zeros((4, 3))), 3, 2).values) == 0 and X.dense_svd(dense(spark, np.ones((4, 3))), 3, 2).left.count() == 4


def test_topics_equal_numpy(spark):
    rng = random.Random(4)
    themes = [["budget", "revenue", "profit", "quarter", "audit"], ["river", "forest", "mountain", "lake", "valley"], ["piano", "violin", "concert", "melody", "rhythm"]]
    texts = [" ".join(rng.choices(themes[i % 3] if rng.random() < 0.95 else sum(themes, []), weights=None, k=30 + 10 * (i % 3))) + " the of" for i in range(45)] + [""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in X.topics(X.tfidf(docs), 3).collect():
        got[(r.topic, r.rank)] = r
    words = sorted({w for t in texts for w in t.split()} - set(STOP_WORDS))
    tf = np.array([[t.split().count(w) for w in words] for t in texts], dtype=float)
    m = tf * (np.log((len(texts) + 1) / ((tf > 0).sum(axis=0) + 1)) + 1)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    m = m / np.where(norms == 0, 1, norms)
    _, s, vt = np.linalg.svd(m, full_matrices=False)
    for k in range(3):
        order = sorted(range(len(words)), key=lambda i: (-round(abs(vt[k, i]), 9), words[i]))[:5]
        assert [got[(k + 1, n)].term for n in range(1, 6)] == [words[i] for i in order]
        assert abs(got[(k + 1, 1)].weight - s[k] / max(1.0, s[0])) < 1e-9
        assert got[(k + 1, 1)].name == " ".join(words[i] for i in order[:2]).title()
        assert all(abs(abs(got[(k + 1, n)].loading) - abs(vt[k, i])) < 1e-7 for n, i in enumerate(order, 1))


def brute_search(m, q, k, top):
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    p = (vt[:k].T @ np.diag(1 / s[:k]) @ u[:, :k].T @ q)[: m.shape[0]]
    score = [0.0 if np.linalg.norm(c) < 1e-12 or np.linalg.norm(p) < 1e-12 else float(p @ c / np.linalg.norm(p) / np.linalg.norm(c)) for c in m.T]
    return sorted(((-round(x, 12), j, x) for j, x in enumerate(score)))[:top]


def test_svd_search_equals_numpy(spark):
    rng = np.random.default_rng(5)
    u, _ = np.linalg.qr(rng.standard_normal((12, 12)))
    v, _ = np.linalg.qr(rng.standard_normal((40, 12)))
    m = u @ np.diag([9, 8, 7, 6, 1, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3]) @ v.T
    m[:, 7] = 0
    q = rng.standard_normal(12)
    got = X.svd_search(entries(spark, m), X.truncated_svd(entries(spark, m), 4, tolerance=1e-13), list(q), 12).orderBy("rank").collect()
    want = brute_search(m, q, 4, 12)
    assert [r["rank"] for r in got] == list(range(1, 13)) and [r["col"] for r in got] == [j for _, j, _ in want]
    assert max(abs(r.score - x) for r, (_, _, x) in zip(got, want)) < 1e-6


def test_factor_queries_over_tables(spark):
    m = array(plans.vectors(spark, SF), 64)
    r = np.zeros((64, 64))
    for row in plans.vector_qr(spark, SF).collect():
        r[row.i, row.j] = row.r
    want = np.linalg.qr(m, mode="r")
    assert np.abs(r - want * np.sign(np.diag(want))[:, None]).max() < 1e-9
    _, s, vt = np.linalg.svd(m.T, full_matrices=False)
    got = plans.vector_projections(spark, SF).collect()
    assert len(got) == 5 * len(m)
    for k in range(5):
        x = np.array([g.score for g in sorted((g for g in got if g.component == k + 1), key=lambda g: g.vec_id)])
        assert min(np.abs(x - s[k] * vt[k]).max(), np.abs(x + s[k] * vt[k]).max()) < 1e-9
    found = plans.svd_column_search(spark, SF).orderBy("rank").collect()
    best = brute_search(m.T, m[0], 10, 10)
    assert max(abs(r.score - x) for r, (_, _, x) in zip(found, best)) < 1e-9
    assert plans.document_topics(spark, SF).count() == 25


def test_topics_of_blocks_equal_those_of_entries(spark, monkeypatch):
    """Texts in blocks: no product is joined entry by entry; words of one text or block, and texts without words, count as they do there."""
    rng = random.Random(6)
    themes = [[f"{a}{i}" for i in range(8)] for a in "xyz"]
    texts = [" ".join(rng.choices(themes[i % 3], k=20 + 10 * (i % 3)) + [f"once{i}", "the"]) for i in range(60)] + ["", None, "the of"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {(r.topic, r.rank): r for r in X.topics(X.tfidf(docs), 3).collect()}
    monkeypatch.setattr(X, "product", None)
    monkeypatch.setattr(X, "TEXTS", 7)
    monkeypatch.setattr(X, "PACKED", 50)
    for tolerance in (1e-12, 1e-9):
        got = {(r.topic, r.rank): r for r in X.text_topics(docs, 3, tolerance=tolerance).collect()}
        assert {at: (r.term, r.name) for at, r in got.items()} == {at: (r.term, r.name) for at, r in want.items()}
        assert max(abs(got[at].loading - r.loading) + abs(got[at].weight - r.weight) for at, r in want.items()) < (1e-6 if tolerance == 1e-12 else 1e-4)
    assert X.text_topics(docs.where("text = ''"), 3).count() == 0
    one = X.text_topics(spark.createDataFrame([(1, "pear")], "doc_id long, text string"), 3).collect()
    assert [(r.term, round(abs(r.loading), 9)) for r in one] == [("pear", 1.0)]
