"""Persistence against a plain reduction of the whole boundary matrix."""

import math
import random
from collections import defaultdict
from itertools import combinations

import pytest

from docweave.operators import topology as T
from docweave.plans import registry
from docweave.plans.topology import elements

SF = "/root/testdata/sf0.001"


def plain(points, reach):
    """(dimension, birth, death) by reducing all columns of vertices, edges and triangles in order of their diameters."""
    far = lambda s: max((math.dist(points[a], points[b]) for a, b in combinations(s, 2)), default=0.0)
    simplices = sorted((far(s), k, s) for k in (1, 2, 3) for s in combinations(sorted(points), k) if far(s) <= reach)
    at = {s: i for i, (_, _, s) in enumerate(simplices)}
    low, born, out = {}, set(), []
    for i, (d, k, s) in enumerate(simplices):
        column = {at[f] for f in combinations(s, k - 1)} if k > 1 else set()
        while column and max(column) in low:
            column ^= low[max(column)]
        if column:
            low[max(column)] = column
            born.discard(max(column))
            b, kb, _ = simplices[max(column)]
            if d > b or kb == 1:
                out.append((kb - 1, round(b, 9), round(d, 9)))
        else:
            born.add(i)
    out += [(simplices[i][1] - 1, round(simplices[i][0], 9), None) for i in born if simplices[i][1] < 3]
    return sorted(out, key=str)


@pytest.mark.parametrize("dimensions,reach", [(2, 0.5), (3, 0.9), (1, 0.2)])
def test_diagrams_equal_a_plain_reduction(spark, dimensions, reach):
    rng = random.Random(dimensions)
    groups = {g: {i: [rng.uniform(-1, 1) for _ in range(dimensions)] for i in range(n)} for g, n in ((1, 22), (2, 1), (3, 15))}
    if dimensions == 2:
        groups[4] = {i: [math.cos(i * math.pi / 6), math.sin(i * math.pi / 6)] for i in range(12)}  # a ring
        groups[5] = {i: [float(i % 3) / 2, float(i // 3) / 2] for i in range(9)}  # ties
    rows = [(g, i, v) for g, ps in groups.items() for i, v in ps.items()]
    df = spark.createDataFrame(rows + [(1, 900, None), (1, None, [0.0] * dimensions), (3, 901, [float("nan")] * dimensions)], "g int, id long, v array<double>").repartition(3)
    got = defaultdict(list)
    for r in T.persistence(df, ["g"], dimensions, reach).collect():
        got[r.g].append((r.dimension, round(r.birth, 9), None if r.death is None else round(r.death, 9)))
    for g, ps in groups.items():
        assert sorted(got[g], key=str) == plain(ps, reach), g
    if dimensions == 2:
        assert [x for x in plain(groups[4], reach) if x[0] == 1] == [] or any(x[0] == 1 for x in got[4])


def test_a_ring_has_one_loop_and_empty_tables_nothing(spark):
    ring = [(i, [math.cos(i * math.pi / 6), math.sin(i * math.pi / 6)]) for i in range(12)]
    df = spark.createDataFrame(ring, "id long, v array<double>")
    loops = T.persistence(df, [], 2, 1.9).where("dimension = 1").collect()
    assert len(loops) == 1 and loops[0].birth == pytest.approx(2 * math.sin(math.pi / 12)) and loops[0].death == pytest.approx(math.sqrt(3))
    assert T.persistence(df.limit(0), [], 2, 1.0).count() == 0


def test_layouts_of_the_tables(spark):
    points = defaultdict(dict)
    for r in elements(spark, SF).collect():
        points[r.doc_id][r.seq] = [(r.x0 + r.x1) / 2, r.page + (r.y0 + r.y1) / 2]
    got = defaultdict(list)
    for r in registry.QUERIES["layout_persistence"](spark, SF).collect():
        got[r.doc_id].append((r.dimension, r.birth, r.death))
    some = [d for d in points if len(points[d]) < 25][:40]
    assert set(got) == set(points) and all(sorted(got[d], key=str) == plain(points[d], 0.35) for d in some)


def test_small_groups_take_no_rounds(spark, monkeypatch):
    """Groups of few points are solved in their rows, to the same results as by rounds over all edges; repeated ids and null groups go the long way."""
    rng = random.Random(9)
    groups = {g: {i: [rng.uniform(-1, 1), rng.uniform(-1, 1)] for i in range(n)} for g, n in ((1, 18), (2, 1), (3, 9))}
    rows = [(g, i, v) for g, ps in groups.items() for i, v in ps.items()]
    few = spark.createDataFrame(rows + [(1, 900, None), (4, None, [0.0, 0.0])], "g int, id long, v array<double>").repartition(3)

    def found(df):
        return sorted(((r.g, r.dimension, round(r.birth, 9), None if r.death is None else round(r.death, 9)) for r in T.persistence(df, ["g"], 2, 0.6).collect()), key=str)

    want = sorted(((g, *x) for g, ps in groups.items() for x in plain(ps, 0.6)), key=str)
    with monkeypatch.context() as m:
        m.setattr(T, "spanning_forest", None)
        assert found(few) == want
    monkeypatch.setattr(T, "POINTS", 12)
    more = few.unionByName(spark.createDataFrame([(5, 1, [0.0, 0.0]), (5, 1, [0.0, 0.0]), (None, 1, [0.0, 0.0])], "g int, id long, v array<double>"))
    assert found(more) == sorted([*want, (5, 0, 0.0, None), (None, 0, 0.0, None)], key=str)
