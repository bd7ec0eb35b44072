"""Tensor factors and spectral clusters: planted ones come back, others equal NumPy's."""

import itertools

import numpy as np
import pytest

from docweave.operators import spectral as S
from docweave.operators import tensor_factors as T

MODES = ["a", "b", "c"]


def entries(spark, x):
    rows = [(*map(int, at), float(v)) for at, v in np.ndenumerate(x) if v]
    return spark.createDataFrame(rows, "a long, b long, c long, value double").repartition(4)


def array(df):
    return np.array([r.v for r in df.orderBy("id").collect()])


def test_cp_recovers_planted_parts(spark):
    rng = np.random.default_rng(2)
    planted = [np.abs(rng.standard_normal((n, 2))) * (rng.random((n, 2)) < 0.7) + 0.05 for n in (12, 9, 7)]
    x = np.einsum("ar,br,cr->abc", *planted)
    found = T.cp(entries(spark, x), MODES, 2, rounds=60, tolerance=1e-7)
    assert found.error < 1e-2 and found.explained > 0.9999
    got = [array(f) for f in found.factors]
    assert np.linalg.norm(np.einsum("ar,br,cr->abc", *got) - x) / np.linalg.norm(x) == pytest.approx(found.error, abs=1e-6)
    unit = lambda m: m / np.linalg.norm(m, axis=0)
    alike = [np.abs(unit(g).T @ unit(p)) for g, p in zip(got, planted)]
    assert max(min(m[i, order[i]] for m in alike for i in range(2)) for order in itertools.permutations(range(2))) > 0.98


def test_cp_rounds_equal_numpy(spark):
    """From one start, the first rounds are those of the dense algorithm."""
    rng = np.random.default_rng(4)
    x = rng.random((6, 5, 4)) * (rng.random((6, 5, 4)) < 0.8)
    start = [array(f) for f in T.cp(entries(spark, x), MODES, 2, rounds=0).factors]
    for signed in (True, False):
        f = [m.copy() for m in start]
        for _ in range(2):
            for n, others in enumerate(("abc,br,cr->ar", "abc,ar,cr->br", "abc,ar,br->cr")):
                rest = [m for i, m in enumerate(f) if i != n]
                f[n] = np.einsum(others, x, *rest) @ np.linalg.pinv((rest[0].T @ rest[0]) * (rest[1].T @ rest[1]))
                f[n] = f[n] if signed else np.maximum(f[n], 0)
        got = T.cp(entries(spark, x), MODES, 2, rounds=2, tolerance=0, nonnegative=not signed)
        assert all(np.abs(array(g) - w).max() < 1e-8 for g, w in zip(got.factors, f))
        assert got.error == pytest.approx(np.linalg.norm(np.einsum("ar,br,cr->abc", *f) - x) / np.linalg.norm(x), abs=1e-7)


def test_tucker(spark):
    rng = np.random.default_rng(5)
    q = [np.linalg.qr(rng.standard_normal((n, r)))[0] for n, r in ((10, 3), (8, 2), (6, 2))]
    x = np.einsum("ijk,ai,bj,ck->abc", rng.standard_normal((3, 2, 2)), *q)
    found = T.tucker(entries(spark, x), MODES, [3, 2, 2], rounds=4)
    got = [array(f) for f in found.factors]
    assert found.error < 1e-6 and found.core.shape == (3, 2, 2)
    assert np.abs(np.einsum("ijk,ai,bj,ck->abc", found.core, *got) - x).max() < 1e-8
    assert all(np.abs(f.T @ f - np.eye(f.shape[1])).max() < 1e-10 for f in got)
    noisy = x + 0.05 * rng.standard_normal(x.shape)
    found = T.tucker(entries(spark, noisy), MODES, [3, 2, 2], rounds=8)
    u = [np.linalg.svd(np.moveaxis(noisy, n, 0).reshape(noisy.shape[n], -1))[0][:, :r] for n, r in enumerate((3, 2, 2))]
    for _ in range(30):
        for n, spec in enumerate(("abc,bj,ck->ajk", "abc,ai,ck->bik", "abc,ai,bj->cij")):
            y = np.einsum(spec, noisy, *[m for i, m in enumerate(u) if i != n])
            u[n] = np.linalg.svd(y.reshape(len(y), -1), full_matrices=False)[0][:, : (3, 2, 2)[n]]
    core = np.einsum("abc,ai,bj,ck->ijk", noisy, *u)
    assert (found.core**2).sum() == pytest.approx((core**2).sum(), rel=1e-6)


def test_tensors_without_entries_and_with_nulls(spark):
    none = entries(spark, np.ones((1, 1, 1))).limit(0)
    assert T.cp(none, MODES, 2).error == 0 and T.tucker(none, MODES, [1, 1, 1]).core.size == 0
    e = spark.createDataFrame([("x", "y", 1, 2.0), ("x", "y", 1, 1.0), (None, "y", 1, 5.0), ("x", "z", 1, None), ("x", "z", 2, 0.0)], "a string, b string, c int, value double")
    found = T.tucker(e, MODES, [2, 2, 2], rounds=2)
    assert found.core.shape == (1, 1, 1) and abs(found.core.item()) == pytest.approx(3) and found.error < 1e-6
    with pytest.raises(ValueError):
        T.tucker(e, MODES, [2, 0, 2])


def test_spectral_clusters_find_planted_blocks(spark):
    rng = np.random.default_rng(6)
    block = np.repeat([0, 1, 2], 30)
    edges = [(i, j, 1.0) for i in range(90) for j in range(i) if rng.random() < (0.5 if block[i] == block[j] else 0.02)] + [(3, 3, 9.0), (1, 2, -4.0), (0, 1, 0.0)]
    e = spark.createDataFrame(edges, "src long, dst long, weight double").repartition(3)
    got = {r.node: r.cluster for r in S.spectral_clusters(e, 3).collect()}
    assert [got[i] for i in range(90)] == block.tolist()
    w = np.zeros((90, 90))
    for i, j, x in edges:
        if x > 0 and i != j:
            w[i, j] += x
            w[j, i] += x
    d = w.sum(axis=1)
    want = np.linalg.eigvalsh(np.eye(90) - w / np.sqrt(np.outer(d, d)))[:3]
    values, vectors = S.laplacian_vectors(e, 3)
    v = array(vectors)
    assert np.abs(values - want).max() < 1e-6 and np.abs(v.T @ v - np.eye(3)).max() < 1e-9
    apart = spark.createDataFrame([("a", "b", 1.0), ("c", "d", 2.0)], "src string, dst string, weight double")
    assert {r.node: r.cluster for r in S.spectral_clusters(apart, 2).collect()} == {"a": 0, "b": 0, "c": 1, "d": 1}
    assert S.spectral_clusters(apart.limit(0), 2).count() == 0


def test_k_means(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.standard_normal((40, 2)) + c for c in ((0, 0), (12, 0), (0, 12))])
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, v array<double>").repartition(3)
    found, centres = S.k_means(df, 3)
    at = {r.id: (r.cluster, r.distance) for r in found.collect()}
    for c in range(3):
        own = [i for i in at if at[i][0] == c]
        assert len({i // 40 for i in own}) == 1 and np.abs(centres[c] - x[own].mean(axis=0)).max() < 1e-9
    assert all(abs(d - ((x[i] - centres[c]) ** 2).sum()) < 1e-9 for i, (c, d) in at.items())
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "id long, v array<double>")
    assert {r.cluster for r in S.k_means(same, 3)[0].collect()} == {0} and S.k_means(same.limit(0), 3)[0].count() == 0
