"""Operators that shuffled all words or called Python once a group: what they shuffle now, and the same results."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from docweave.functions import text as T
from docweave.operators import analysis as A
from docweave.operators import elements as E
from docweave.operators import spectral
from docweave.operators import text_stats as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keyphrases_shuffle_few_words(spark):
    rows = [(1, "apple " * 9 + "pear plum pear plum fig"), (2, "fig plum fig grape"), (2, "grape fig fig"), (3, ""), (4, None), (None, "plum fig plum fig"), (5, "apple")]
    found = S.keyphrases(spark.createDataFrame(rows, "id long, t string"), "t", "id", 3)
    assert "tf_a" not in plan(found)  # pairs met their words' counts by joins before
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append([w for w in (t or "").split() if w not in T.STOP_WORDS])
    tf = {i: Counter(x for w in ws for x in w) for i, ws in texts.items()}
    df = Counter(x for c in tf.values() for x in c)
    want = {}
    for i, ws in texts.items():
        scored = [(c * (math.log((1 + len(rows)) / (1 + df[x])) + 1), x) for x, c in tf[i].items()]
        if i is not None:
            scored += [(tf[i][x] * tf[i][y] * 1.5, f"{x} {y}") for x, y in {p for w in ws for p in zip(w, w[1:])}]
        for rank, (s, x) in enumerate(sorted(scored, key=lambda r: (-round(r[0], 9), r[1]))[:3], 1):
            want[i, rank] = (x, round(s, 6))
    assert {(r.id, r.rank): (r.phrase, round(r.score, 6)) for r in found.collect()} == want


def test_importance_with_few_common_words(spark, monkeypatch):
    """Words beyond those sent to all tasks count just as much."""
    lines = [(1, i, 1, "text", t, 0.0, 0.0, 0.4, 0.1, "s") for i, t in enumerate(["a a b", "b c d", "d d d e", "", "a a b"])]
    e = spark.createDataFrame(lines, "doc_id long, seq long, page int, type string, content string, x0 double, y0 double, x1 double, y1 double, section string")
    all_common = {r.seq: (r.raw, r.weight) for r in E.importance(e).collect()}
    monkeypatch.setattr(E, "COMMON_WORDS", 2)
    assert {r.seq: (r.raw, r.weight) for r in E.importance(e).collect()} == all_common
    tf = Counter("a a b b c d d d d e a a b".split())
    mean = sum(tf[w] for w in "b c d".split()) / 3
    assert abs(all_common[1][0] - (0.5 / (1 + math.log1p(mean)) + 0.3 * 0.5 + 0.2 * 0.08)) < 1e-8


def test_chunks_take_many_documents_a_batch(spark):
    e = spark.createDataFrame([(d, i, "table" if i == 3 else "text", n) for d in (1, None) for i, n in enumerate([5, 5, 9, 1, 2, 8])], "d long, seq long, type string, tokens long")
    found = A.chunks(e, "d", 10, ["table"])
    assert "FlatMapGroups" not in plan(found)
    want = [(0, 0, 1, 10), (1, 2, 2, 9), (2, 3, 3, 1), (3, 4, 5, 10)]
    for d in (1, None):
        assert sorted(tuple(r)[1:] for r in found.where(F.col("d").eqNullSafe(F.lit(d))).collect()) == want


def test_centrality_sends_no_table_through_the_driver(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 2.0)], "src string, dst string, w double")
    now = spark.createDataFrame([("a", 1.0), ("b", 0.5), ("c", 0.0)], "node string, x double")
    found = spectral.passed_on(e, now)
    assert {r.node: r.got for r in found.collect()} == {"a": 0.5, "b": 1.0, "c": 1.0}
    assert "BroadcastExchange" not in plan(found) + plan(now.join(found, "node", "left"))


def test_sentences_are_ranked_many_texts_a_batch(spark):
    s = spark.createDataFrame([(1, 0, ["a", "b", "a"]), (1, 1, ["b", "c"]), (1, 2, ["d"]), (2, 0, []), (None, 0, ["x"]), (None, 1, ["x"])], "d long, i int, words array<string>")
    found = A.text_rank(s, "d")
    assert "FlatMapGroups" not in plan(found)
    got = {(r.d, r.i): round(r.score, 6) for r in found.collect()}
    assert got[1, 0] == got[1, 1] == round(0.05 / (1 - 0.85), 6) and got[1, 2] == 0.05 and got[2, 0] == 0.15 and got[None, 0] == 0.5


def test_band_pairs_shuffle_no_pairs(spark, monkeypatch):
    """Each pair that shares a band once, with its similarity, also of bands that are dealt to several tasks; before, all pairs met again by joins."""
    rng = np.random.default_rng(5)
    rows = [(int(i) * 3, [int(x) for x in rng.integers(0, 3, 8)]) for i in rng.permutation(60)] + [(1000 + i, [1, 1, i, 50 + i, 100 + i, i, i, i]) for i in range(40)]
    rows = [(i, s) for i, s in rows if s not in [x for j, x in rows if j < i]]
    for members in (2048, 7):
        monkeypatch.setattr(S, "MEMBERS", members)
        found = S.band_pairs(spark.createDataFrame(rows, "id long, signature array<int>").repartition(3), "id", 4, 2)
        assert "Join" not in plan(found).split("MapInArrow")[0]
        got = sorted((r.a, r.b, r.similarity) for r in found.collect())
        want = []
        for i, x in rows:
            for j, y in rows:
                if i < j and any(x[k : k + 2] == y[k : k + 2] for k in range(0, 8, 2)):
                    want.append((i, j, sum(p == q for p, q in zip(x, y)) / 8))
        assert got == sorted(want) and len(got) > 700
    assert S.band_pairs(spark.createDataFrame([], "id long, signature array<int>"), "id", 4, 2).count() == 0


def test_signatures_of_batches_equal_minhash(spark):
    docs = spark.createDataFrame([(1, "a b \u00e9t\u00e9 b"), (2, ""), (3, None), (4, "x"), (5, "\u4e2d\u6587 a")], "id long, t string")
    want = {r.id: r.s for r in docs.select("id", S.minhash(T.words(F.col("t")), 16).alias("s")).collect() if r.id in (1, 4, 5)}
    assert {r.id: r.signature for r in S.min_signatures(docs, "id", T.words(F.col("t")), 16).collect()} == want


def test_few_targets_take_the_same_rounds_without_edges(spark, monkeypatch):
    """Against the rounds over the whole matrix, stopped before they settle; no round multiplies by the edges."""
    rng = np.random.default_rng(8)
    rows = [(f"c{i}", f"b{int(j)}", float(rng.integers(1, 9))) for i in range(40) for j in rng.choice(6, 3, replace=False)] + [("c1", "b1", 2.0), ("c1", "b2", 0.0), ("c2", "c2", 1.0), ("lone", "end", 1.0)]
    monkeypatch.setattr(spectral, "product", None)
    values, vectors = spectral.laplacian_vectors(spark.createDataFrame(rows, "src string, dst string, weight double"), 3, rounds=3, tolerance=0.0)
    got = {r.id: r.v for r in vectors.collect()}
    nodes = sorted({x for a, b, w in rows if w > 0 and a != b for x in (a, b)})
    w = np.zeros((len(nodes),) * 2)
    for a, b, x in rows:
        if a != b:
            w[nodes.index(a), nodes.index(b)] += x
    w += w.T
    m = (np.eye(len(nodes)) + w / np.sqrt(np.outer(w.sum(axis=0), w.sum(axis=0)))) / 2
    start = {r.id: r.v for r in spark.createDataFrame([(n,) for n in nodes], "id string").select("id", F.array(*spectral.signs(F.col("id"), 7, 3)).alias("v")).collect()}
    q = np.linalg.qr(np.linalg.matrix_power(m, 3) @ np.array([start[n] for n in nodes]))[0]
    want, turn = np.linalg.eigh(q.T @ m @ q)
    assert got.keys() == set(nodes) and np.abs(values - (2 - 2 * want[::-1][:3])).max() < 1e-9
    a, b = np.array([got[n] for n in nodes]), (q @ turn)[:, ::-1][:, :3]
    assert np.abs(a.T @ a - np.eye(3)).max() < 1e-9 and np.abs(np.abs((a * b).sum(axis=0)) - 1).max() < 1e-9
