"""Exact neighbours against all distances, and hitting times against NumPy."""

import numpy as np
import pytest

from docweave.operators import flow, space
from docweave.plans import registry

SF = "/root/testdata/sf0.001"
NAN = float("nan")


@pytest.mark.parametrize("dimensions,leaf", [(1, 20), (2, 40), (3, 1000), (2, 7)])
def test_neighbours_equal_all_distances(spark, dimensions, leaf):
    rng = np.random.default_rng(dimensions)
    x = np.concatenate([rng.standard_normal((220, dimensions)), rng.integers(-2, 3, (60, dimensions)) / 2, np.zeros((40, dimensions))])  # ties and one crowded place
    asked = np.concatenate([x[::9], rng.standard_normal((10, dimensions)) * 5])
    points = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(900, None), (901, [NAN] * dimensions), (902, [1.0] * (dimensions + 1)), (None, [0.0] * dimensions)], "id long, v array<double>").repartition(3)
    queries = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(asked)] + [(99, None)], "query_id int, v array<double>")
    got = {}
    counts = {}
    for r in space.nearest(points, queries, 6, dimensions, leaf=leaf).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.id, r.distance)
        counts[r.query_id] = r.candidates
    assert sorted(got) == list(range(len(asked)))
    for i, v in enumerate(asked):
        d = np.sqrt(((x - v) ** 2).sum(axis=1))
        best = np.lexsort((np.arange(len(x)), d))[:6]
        assert [got[i][n] for n in range(1, 7)] == [(int(j), float(d[j])) for j in best]
    if leaf == 20:
        assert np.mean(list(counts.values())) < 0.6 * len(x)  # most leaves are never searched


def test_few_points_and_none(spark):
    points = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "id long, v array<double>")
    queries = spark.createDataFrame([("q", [0.0, 0.0])], "query_id string, v array<double>")
    assert [(r.id, r.distance) for r in space.nearest(points, queries, 9, 2).orderBy("rank").collect()] == [(1, 0.0), (2, 5.0)]
    assert space.nearest(points.limit(0), queries, 3, 2).count() == 0 and space.nearest(points, queries.limit(0), 3, 2).count() == 0


def steps_by_solving(edges, targets):
    nodes = sorted({n for a, b, w in edges if w > 0 for n in (a, b)})
    at = {n: i for i, n in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for a, b, w in edges:
        if w > 0:
            m[at[a], at[b]] += w
            m[at[b], at[a]] += w
    reach = np.linalg.matrix_power((m > 0) + np.eye(len(nodes)), len(nodes)) > 0
    ends = [at[t] for t in targets if t in at]
    free = [i for i in range(len(nodes)) if i not in ends and reach[i, ends].any()]
    p = m / m.sum(axis=1, keepdims=True)
    h = np.linalg.solve(np.eye(len(free)) - p[np.ix_(free, free)], np.ones(len(free))) if free else []
    out = {nodes[i]: 0.0 for i in ends} | {nodes[i]: float(x) for i, x in zip(free, h)}
    return {n: out.get(n) for n in nodes}


def test_hitting_times_equal_a_dense_solution(spark):
    rng = np.random.default_rng(3)
    edges = [(f"n{a}", f"n{b}", float(w)) for a, b, w in zip(rng.integers(0, 25, 60), rng.integers(0, 25, 60), rng.integers(1, 5, 60))]
    edges += [("x", "y", 1.0), ("y", "z", 2.0), ("n1", "n1", 3.0), ("n2", "w", -1.0), ("n2", "n3", 0.0)]
    df = spark.createDataFrame(edges + [(None, "n1", 1.0)], "src string, dst string, weight double").repartition(3)
    targets = spark.createDataFrame([("n0",), ("n7",), ("away",), (None,), ("n0",)], "node string")
    found = flow.hitting_times(df, targets)
    got, want = {r.node: r.steps for r in found.steps.collect()}, steps_by_solving(edges, ["n0", "n7", "away"])
    assert got.keys() == want.keys() and found.residual <= 1e-10
    assert all((got[n] is None and want[n] is None) or got[n] == pytest.approx(want[n], rel=1e-7) for n in want)
    assert got["x"] is None and got["n0"] == 0.0
    assert flow.hitting_times(df.limit(0), targets).steps.count() == 0
    assert all(r.steps is None for r in flow.hitting_times(df, targets.limit(0)).steps.collect())


def test_hitting_times_of_the_tables(spark):
    from docweave.sources.relations import edges

    e = [(r.src, r.dst, r.weight) for r in edges(spark, SF).collect()]
    want = steps_by_solving(e, [n for n in {x for a, b, _ in e for x in (a, b)} if n.startswith("r")])
    got = {r.node: r.steps for r in registry.QUERIES["region_hitting_times"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(got[n] == pytest.approx(want[n], rel=1e-6) for n in want)
