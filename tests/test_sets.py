"""Set joins: all similar pairs, and few others."""

import random

from pyspark.sql import functions as F

from docweave.operators import compliance as C
from docweave.operators import text_stats as S


def test_sets_meet_if_similar_and_seldom_else(spark):
    """Texts that share a few rare words of many met before in one row for each word."""
    rng = random.Random(4)
    rows = []
    for i in range(240):
        if i % 4 == 3:  # most of the words of the one before
            w = [x for x in rows[-1][1] if rng.random() < 0.9] + [f"own{i}x{j}" for j in range(3)]
        else:
            w = [f"r{x}" for x in rng.sample(range(600), rng.choice([1, 2, 3, 9, 40, 120]))]
        rows.append((i, w))
    df = spark.createDataFrame(rows, "id long, w array<string>")
    for least in (0.3, 0.5, 0.8):
        met = {(r.a, r.b) for r in S.meeting_sets(df, least).collect()}
        want = {(a, b) for a, x in rows for b, y in rows if a < b and len(set(x) & set(y)) / len(set(x) | set(y)) >= least}
        assert want, least
        assert want <= met, want - met
    meet = sum(bool(set(x) & set(y)) for i, (_, x) in enumerate(rows) for _, y in rows[:i])
    assert len(met) < meet / 20
    found = S.similar_sets(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "id long, t string"), "id", F.split("t", " "), 0.5).collect()
    exact = {(a, b) for a, x in rows for b, y in rows if a < b and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.5}
    equal = {frozenset(x) for _, x in rows}
    assert {(r.a, r.b) for r in found} <= exact and (len(equal) < len(rows) or {(r.a, r.b) for r in found} == exact)


def test_evidence_of_copies_is_compared_once(spark):
    claims = spark.createDataFrame([(i, "alpha beta gamma delta") for i in range(0, 40)] + [(90, "nothing like it"), (91, "")], "claim_id long, claim string")
    known = spark.createDataFrame([(i, "Alpha beta gamma, epsilon") for i in range(100, 140)] + [(140, "delta gamma beta alpha"), (141, "beta delta alpha gamma")], "known_id long, known string")
    got = {r.claim_id: (r.known_id, r.similarity, r.status) for r in C.best_evidence(claims, known).collect()}
    assert all(got[i] == (140, 1.0, "supported") for i in range(40))
    assert got[90] == got[91] == (None, 0.5, "unverified")


def test_blocks_of_sets_stay_light():
    """One group held all sets of similar size before, however many there were."""
    sizes = [(1, 40_000), (50, 900_000), (51, 3), (3000, 20_000)]
    places, ends = S.size_blocks(sizes, 4)
    weight = {n: c * (256 + n) ** 0.5 for n, c in sizes}
    assert len(ends) >= sum(weight.values()) / S.HEAVY > 4
    assert [n for n, _, _ in places] == [n for n, _ in sizes]
    for n, start, width in places:
        assert abs(weight[n] / width - sum(weight.values()) / len(ends)) < 1
        assert all(ends[min(k, len(ends) - 1)][0] <= n <= ends[min(k, len(ends) - 1)][1] for k in range(int(start), int(start + width) + 1))
    assert S.size_blocks([(9, 5)], 4)[1] == [(9, 9)]


def test_pairs_are_whole_over_many_blocks_and_sides(spark, monkeypatch):
    monkeypatch.setattr(S, "LIGHT", 300)
    rng = random.Random(7)
    rows = []
    for i in range(400):
        if i % 3:  # like one of those before
            w = [x for x in rng.choice(rows)[1] if rng.random() < 0.8] + [f"own{i}"]
        else:
            w = [f"r{x}" for x in rng.sample(range(900), rng.choice([1, 2, 5, 12, 13, 60, 300]))]
        rows.append((i, w))
    df = spark.createDataFrame(rows, "id long, w array<string>")
    similar = lambda x, y, least: len(set(x) & set(y)) >= least * len(set(x) | set(y)) - 1e-9
    for least in (0.3, 0.5):
        met = [(r.a, r.b) for r in S.meeting_sets(df, least).collect()]
        want = {(a, b) for a, x in rows for b, y in rows if a < b and similar(x, y, least)}
        assert len(want) > 100 and set(met) == want and len(met) == len(want)
        # ids of the two sides may be the same
        sides = df.selectExpr("id div 2 AS id", "CAST(id % 2 AS int) AS side", "w")
        met = [(r.a, r.b) for r in S.meeting_sets(sides, least).collect()]
        want = {(a // 2, b // 2) for a, x in rows for b, y in rows if a % 2 == 0 and b % 2 == 1 and similar(x, y, least)}
        assert set(met) == want and len(met) == len(want)
    assert S.meeting_sets(df.limit(0), 0.5).count() == 0 and S.meeting_sets(sides.where("side = 1"), 0.5).count() == 0
