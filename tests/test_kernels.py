"""Numeric kernels against plain enumeration."""

from itertools import permutations, product

import numpy as np
import pytest

from docweave.operators import decisions, kernels, paths
from docweave.plans import registry


def test_hull_holds_all_points_and_only_corners(spark):
    rng = np.random.RandomState(1)
    for _ in range(40):
        points = np.unique(rng.randint(0, 9, (rng.randint(3, 30), 2)).astype(float), axis=0)
        corners = kernels.convex_hull(points)
        if len(corners) < 3:
            continue
        turn = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
        sides = list(zip(corners, np.roll(corners, -1, axis=0)))
        assert all(turn(a, b, p) >= 0 for a, b in sides for p in points)
        assert all(turn(corners[i - 2], corners[i - 1], corners[i]) > 0 for i in range(len(corners)))
    got = registry.QUERIES["customer_hulls"](spark, "/root/testdata/sf0.001").toPandas()
    customers = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").toPandas()
    for segment, rows in got.groupby("c_mktsegment"):
        mine = customers[customers.c_mktsegment == segment]
        points = np.unique(np.column_stack((mine.c_custkey % 101, mine.c_acctbal)).astype(float), axis=0)
        assert rows.sort_values("position")[["x", "y"]].to_numpy().tolist() == kernels.convex_hull(points).tolist()


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.RandomState(2)
    for _ in range(30):
        n, m, t = rng.randint(1, 4), rng.randint(1, 4), rng.randint(1, 6)
        start, move, emit = rng.dirichlet(np.ones(n)), rng.dirichlet(np.ones(n), n), rng.dirichlet(np.ones(m), n)
        seen = rng.randint(0, m, t)
        chance = lambda p: start[p[0]] * emit[p[0], seen[0]] * np.prod([move[a, b] * emit[b, o] for a, b, o in zip(p, p[1:], seen[1:])])  # noqa: E731, B023
        path, score = kernels.viterbi(seen, start, move, emit)
        assert np.exp(score) == pytest.approx(max(chance(p) for p in product(range(n), repeat=t))) == pytest.approx(chance(tuple(path)))


def test_knapsacks_of_choices_and_prices():
    rng = np.random.RandomState(3)
    for _ in range(40):
        groups = [[(float(rng.randint(1, 20)), int(rng.randint(1, 9))) for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 5))]
        budget = int(rng.randint(3, 25))
        sums = [(sum(v for v, _ in c), sum(s for _, s in c)) for c in product(*groups)]
        assert kernels.choice_knapsack(groups, budget) == max([v for v, s in sums if s <= budget], default=-np.inf)
        value, size = rng.randint(1, 20, 8).astype(float), rng.randint(1, 9, 8)
        taken = kernels.priced_knapsack(value, size, budget)
        best = max(value[list(c)].sum() for m in range(256) for c in [[i for i in range(8) if m >> i & 1]] if size[list(c)].sum() <= budget)
        assert size[taken].sum() <= budget and len(set(taken)) == len(taken)
        assert value[taken].sum() >= 0.5 * best or value[taken].sum() + max(value[size <= budget], default=0) >= best


def test_shapley_shares_the_whole():
    worth = lambda s: len(s) ** 2 + 3 * ("a" in s)
    got = kernels.shapley(["a", "b", "c"], worth)
    assert sum(got.values()) == pytest.approx(worth("abc")) and got["a"] - got["b"] == pytest.approx(3) and got["b"] == pytest.approx(got["c"])


def test_heat_flows_to_the_mean_and_periods_are_found():
    w = np.array([[0, 1, 0], [1, 0, 2], [0, 2, 0]], float)
    f = np.array([3.0, 0, 0])
    assert kernels.heat(w, f, 0) == pytest.approx(f) and kernels.heat(w, f, 50) == pytest.approx(np.ones(3)) and kernels.heat(w, f, 0.3).sum() == pytest.approx(3)
    share, strong = kernels.periodicity(np.sin(2 * np.pi * 8 * np.arange(128) / 128) + 5)
    assert share == pytest.approx(1) and strong == [8] and kernels.periodicity(np.ones(9)) == (0.0, [])


def test_minimum_under_equalities():
    q, c, a, b = np.diag([2.0, 4.0]), np.array([-2.0, 0.0]), np.array([[1.0, 1.0]]), np.array([1.0])
    x, price = kernels.equality_minimum(q, c, a, b)
    assert a @ x == pytest.approx(b) and q @ x + c + a.T @ price == pytest.approx(np.zeros(2))


def test_consistency_of_pairwise_judgements():
    w = [0.5, 0.3, 0.2]
    assert decisions.consistency(w, [[a / b for b in w] for a in w]) == pytest.approx(0)
    assert decisions.consistency(w, [[1, 9, 1], [1 / 9, 1, 9], [1, 1 / 9, 1]]) > 0.1 and decisions.consistency([0.5, 0.5], [[1, 2], [0.5, 1]]) == 0


def test_betweenness_and_closeness_of_small_graphs():
    rng = np.random.RandomState(5)
    for _ in range(25):
        n = rng.randint(2, 7)
        edges = sorted({(int(a), int(b)) for a, b in rng.randint(0, n, (rng.randint(1, 12), 2)) if a != b})
        if not edges:
            continue
        src, dst = (np.array(x) for x in zip(*edges))
        far = np.full((n, n), np.inf)
        ways = {}
        for s, t in permutations(range(n), 2):
            for k in range(1, n):
                found = [p for p in permutations([v for v in range(n) if v not in (s, t)], k - 1) if all(e in edges for e in zip((s, *p), (*p, t)))]
                if found:
                    far[s, t], ways[s, t] = k, found
                    break
        between, close = paths.betweenness(src, dst, n), paths.closeness(src, dst, n)
        for v in range(n):
            assert between[v] == pytest.approx(sum(sum(v in p for p in found) / len(found) for found in ways.values()))
            reach = [far[u, v] for u in range(n) if u != v and far[u, v] < np.inf]
            assert close[v] == pytest.approx(len(reach) / (n - 1) * len(reach) / sum(reach) if reach else 0)
