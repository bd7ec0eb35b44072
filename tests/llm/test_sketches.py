"""Parity sketches of the near-duplicate stage lose no similar pair and part those that are not."""

import numpy as np
import pyarrow as pa

from docweave.llm import simhash as S


def group(seed: int, count: int, shared: int, own: int) -> list[np.ndarray]:
    """Sets of hashes, most of them common to all."""
    rng = np.random.default_rng(seed)
    draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
    base = draw(shared)
    return [np.unique(np.concatenate([base, draw(int(k))])) for k in rng.integers(own, own + 9, count)]


def met(sets: list[np.ndarray]) -> set[tuple[int, int]]:
    """Pairs of ``across`` for one shingle that all share, each a root of its own."""
    n = len(sets)
    words = np.stack([S.parity_sketch(h) for h in sets]).T
    columns = [np.zeros(n, np.int64), np.arange(n), np.array(list(map(len, sets)), np.int32), np.arange(n), *words]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [f"c{i}" for i in range(len(columns))])
    out = [(a, b) for r in S.across(iter([batch.slice(0, 7), batch.slice(7)]), 0.8) for a, b in zip(r.column(0).to_pylist(), r.column(1).to_pylist())]
    assert len(out) == len(set(out))
    return set(out)


def alike(sets: list[np.ndarray]) -> set[tuple[int, int]]:
    similar = lambda a, b: (k := len(np.intersect1d(a, b))) / (len(a) + len(b) - k) >= 0.8
    return {(i, j) for j in range(len(sets)) for i in range(j) if similar(sets[i], sets[j])}


def test_no_similar_pair_is_lost():
    for own in (6, 9, 12):
        sets = group(own, 40, 100, own)
        want = alike(sets)
        assert want and want <= met(sets)


def test_a_group_of_texts_not_alike_gives_few_pairs():
    sets = group(1, 60, 100, 30)  # similarities of about 0.6; all pairs are 1,770
    assert not alike(sets)
    assert len(met(sets)) < 60
