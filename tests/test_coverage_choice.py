"""Covering choices against enumeration, centrality and cuts against NumPy."""

import itertools
import math
import random

import numpy as np
import pytest

from docweave.operators import coverage as C
from docweave.operators import spectral as S


def value(chosen, covers, weights):
    return sum(weights.get(c, 1.0) for c in set().union(*(covers[i] for i in chosen)) if chosen) if chosen else 0.0


def plain_greedy(sizes, covers, weights, capacity):
    left, covered, out, rest = capacity, set(), [], set(sizes)
    while True:
        fits = [(-sum(weights.get(c, 1.0) for c in covers[i] - covered) / max(1, sizes[i]), i) for i in rest if sizes[i] <= left]
        if not fits or min(fits)[0] >= 0:
            return out
        i = min(fits)[1]
        out.append(i)
        rest.discard(i)
        covered |= covers[i]
        left -= sizes[i]


def tables(spark, sizes, covers, weights):
    return (
        spark.createDataFrame([*sizes.items(), (None, 1), (77, None)], "item long, size long"),
        spark.createDataFrame([(i, c) for i, cs in covers.items() for c in cs] + [(None, "a"), (1, None), (77, "a")], "item long, concept string"),
        spark.createDataFrame([*weights.items(), (None, 9.0)], "concept string, weight double"),
    )


def made(seed, n):
    rng = random.Random(seed)
    covers = {i: set(rng.sample("abcdefghijkl", rng.randint(0, 4))) for i in range(n)}
    return {i: rng.randint(0, 9) for i in range(n)}, covers, {c: rng.choice([0.5, 1.0, 2.0, 5.0]) for c in "abcdefghij"}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_choice_against_enumeration(spark, seed):
    sizes, covers, weights = made(seed, 11)
    capacity = 14
    got = C.best_coverage(*tables(spark, sizes, covers, weights), capacity).orderBy("position").collect()
    chosen = [r.item for r in got]
    best = max(value(s, covers, weights) for k in range(12) for s in itertools.combinations(sizes, k) if sum(sizes[i] for i in s) <= capacity)
    assert sum(sizes[i] for i in chosen) <= capacity and value(chosen, covers, weights) == pytest.approx(sum(r.gain for r in got))
    assert value(chosen, covers, weights) >= (1 - 1 / math.e) * best
    assert chosen == plain_greedy(sizes, covers, weights, capacity) or len(chosen) == 1


def test_lazy_greedy_is_greedy_and_parts_come_near(spark):
    for seed in range(40):
        sizes, covers, weights = made(seed, 25)
        lazy = C.lazy_greedy([(i, s, covers[i]) for i, s in sizes.items()], {c: weights.get(c, 1.0) for c in "abcdefghijkl"}, 20)
        assert [i for i, _, _ in lazy] == plain_greedy(sizes, covers, weights, 20)
    sizes, covers, weights = made(99, 60)
    whole = plain_greedy(sizes, covers, weights, 12)
    for part in (7, 20):
        got = [r.item for r in C.best_coverage(*tables(spark, sizes, covers, weights), 12, part=part).collect()]
        assert sum(sizes[i] for i in got) <= 12 and value(got, covers, weights) >= (1 - 1 / math.e) * value(whole, covers, weights)


def test_a_single_item_may_be_best_and_nothing_may_fit(spark):
    t = tables(spark, {1: 1, 2: 10}, {1: {"a"}, 2: {"b"}}, {"a": 1.0, "b": 9.0})
    assert [(r.item, r.gain) for r in C.best_coverage(*t, 10).collect()] == [(2, 9.0)]
    assert C.best_coverage(*t, 0).count() == 0 and C.best_coverage(*(x.limit(0) for x in t), 9).count() == 0


def test_eigenvector_centrality_and_cut(spark):
    rng = np.random.default_rng(1)
    edges = [(i, j, float(rng.integers(1, 4))) for i in range(20) for j in range(i) if rng.random() < (0.6 if (i < 10) == (j < 10) else 0.05)] + [(i, i - 1, 1.0) for i in range(1, 20)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    a = np.zeros((20, 20))
    for i, j, w in edges:
        a[i, j] += w
        a[j, i] += w
    x = np.abs(np.linalg.eigh(a)[1][:, -1])
    got = {r.node: r.centrality for r in S.eigenvector_centrality(df, directed=False, tolerance=1e-8).collect()}
    assert max(abs(got[i] - x[i]) for i in range(20)) < 1e-5
    low, sides = S.bipartition(df)
    d = a.sum(axis=1)
    values, vectors = np.linalg.eigh(np.eye(20) - a / np.sqrt(np.outer(d, d)))
    side = {r.node: r.side for r in sides.collect()}
    assert low == pytest.approx(values[1], abs=1e-6)
    assert [side[i] for i in range(20)] == [int((vectors[i, 1] < 0) != (vectors[0, 1] < 0)) for i in range(20)]
    one_way = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("a", "c", 1.0), (None, "a", 1.0)], "src string, dst string, weight double")
    got = {r.node: r.centrality for r in S.eigenvector_centrality(one_way, tolerance=1e-9).collect()}
    assert got["a"] == pytest.approx(got["b"], abs=1e-6) and got["c"] == pytest.approx(got["a"], abs=1e-3)
    assert S.eigenvector_centrality(df.limit(0)).count() == 0 and S.bipartition(df.limit(0))[1].count() == 0
