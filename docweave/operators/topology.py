"""Rips complexes of points and their persistence: components by distributed spanning forests, loops by column reduction in bounded parts."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import product
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators.graphs import components, written

#: Edges and triangles that one task reduces; a part with more is refused, not cut.
MAX_SIMPLICES = 2_000_000
#: Points of a group that is solved in one row.
POINTS = 1024


def rips_edges(points: DataFrame, group: list[str], dimensions: int, reach: float) -> DataFrame:
    """(group, a, b, length), a < b: pairs of a group's points (group, id, v) no farther apart than ``reach``.

    Points are binned in cells as wide as the reach; each meets only those of its own and the next cells, and half of these pairs of
    cells suffice.  Points with nulls, other lengths or numbers that are not finite have no edges, as have null ids.
    """
    whole = F.col("id").isNotNull() & (F.size("v") == dimensions) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    p = points.where(F.col("v").isNotNull() & whole).select(*group, "id", F.col("v").cast("array<double>").alias("v"))
    p = written(p.withColumn("cell", F.transform("v", lambda x: F.floor(x / reach))), "points")
    ahead = [s for s in product((-1, 0, 1), repeat=dimensions) if s >= (0,) * dimensions]
    shifts = F.array(*(F.array(*(F.lit(int(x)).cast("long") for x in s)) for s in ahead))
    a = p.select(*group, F.col("id").alias("a"), F.col("v").alias("va"), F.col("cell").alias("own"), F.explode(shifts).alias("shift"))
    a = a.withColumn("cell", F.zip_with("own", "shift", lambda x, y: x + y))
    b = p.select(*group, F.col("id").alias("b"), F.col("v").alias("vb"), "cell")
    met = a.join(b, [*group, "cell"]).where((F.col("own") != F.col("cell")) | (F.col("a") < F.col("b")))
    length = F.sqrt(F.aggregate(F.zip_with("va", "vb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return met.select(*group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), length.alias("length")).where(F.col("length") <= reach)


def spanning_forest(edges: DataFrame, group: list[str]) -> DataFrame:
    """The edges of the least spanning forest of each group, by rounds in which every tree takes its least edge outwards.

    Edges of one length are told apart by their ends, so no round closes a circle; trees at least halve in number each round.
    """
    node = lambda c: F.struct(*group, F.col(c).alias("id"))
    left = written(edges.select(*group, "a", "b", "length", node("a").alias("ta"), node("b").alias("tb")), "edges")
    out = left.select(*group, "a", "b", "length").limit(0)
    while not left.isEmpty():
        rank = F.struct("length", "a", "b")
        ends = left.select(F.explode(F.array("ta", "tb")).alias("tree"), rank.alias("rank"), "ta", "tb", *group)
        least = ends.groupBy("tree").agg(F.min(F.struct("rank", "ta", "tb", *group)).alias("e")).select("e.*")
        least = written(least.distinct(), "least")
        out = written(out.unionByName(least.select(*group, "rank.a", "rank.b", "rank.length")), "forest")
        roots = components(least.select(F.col("ta").alias("src"), F.col("tb").alias("dst")))
        for end in ("ta", "tb"):
            left = left.join(roots.select(F.col("node").alias(end), F.col("component").alias("root")), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        left = written(left.where("ta != tb"), "edges")
    return out


def loops(edges: list[tuple]) -> list[tuple[float, float | None]]:
    """(birth, death) of the loops of a Rips complex given by its edges (a, b, length): a loop is born with the edge that closes it and
    dies with the triangle that fills it; None if none within reach does.  Those that die at once are left out."""
    order = sorted(edges, key=lambda e: (e[2], e[0], e[1]))
    number = {(a, b): i for i, (a, b, _) in enumerate(order)}
    above: dict = {}

    def root(x):
        while above.get(x, x) != x:
            above[x] = x = above.get(above[x], above[x])
        return x

    closing, near = set(), defaultdict(set)
    for i, (a, b, _) in enumerate(order):
        near[a].add(b)
        near[b].add(a)
        ra, rb = root(a), root(b)
        if ra == rb:
            closing.add(i)
        else:
            above[ra] = rb
    triangles = []
    for a, b, _ in order:
        for c in near[a] & near[b]:
            if c > b:
                triangles.append(tuple(sorted((number[(a, b)], number[(a, c)], number[(b, c)]), reverse=True)))
                if len(triangles) + len(order) > MAX_SIMPLICES:
                    raise ValueError(f"a part of over {MAX_SIMPLICES} edges and triangles; take a shorter reach")
    out, held = [], {}
    for t in sorted(triangles):
        column = set(t)
        while column and (low := max(column)) in held:
            column ^= held[low]
        if column:
            held[low] = column
            if order[t[0]][2] > order[low][2]:
                out.append((order[low][2], order[t[0]][2]))
    return out + [(order[i][2], None) for i in closing - held.keys()]


def diagram(ids: list, v: np.ndarray, reach: float) -> list[tuple]:
    """(dimension, birth, death) of one group's points, whose ids differ."""
    order = sorted(range(len(ids)), key=ids.__getitem__)
    v = v[order]
    square = np.zeros((len(ids),) * 2)
    for x in v.T:
        square += (x[:, None] - x) ** 2
    length = np.sqrt(square)
    a, b = np.nonzero(np.triu(length <= reach, 1))
    rank = np.lexsort((b, a, length[a, b]))
    edges = list(zip(a[rank].tolist(), b[rank].tolist(), length[a, b][rank].tolist()))
    above = list(range(len(ids)))

    def root(x):
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    out, parts = [], defaultdict(list)
    for x, y, d in edges:
        if (rx := root(x)) != (ry := root(y)):
            above[rx] = ry
            out.append((0, 0.0, d))
    out += [(0, 0.0, None)] * (len(ids) - len(out))
    for e in edges:
        parts[root(e[0])].append(e)
    return out + [(1, *x) for part in parts.values() if len(part) > 3 for x in loops(part)]


def persistence(points: DataFrame, group: list[str], dimensions: int, reach: float) -> DataFrame:
    """(group, dimension, birth, death) of each group's Rips complex up to ``reach``: 0 for components, 1 for loops; death is null for what lasts.

    A group of at most POINTS points is solved in its row, after one shuffle; larger ones, and those of repeated ids, by ``large_persistence``.
    """
    if not group:
        return large_persistence(points, group, dimensions, reach)
    whole = points.where(F.col("id").isNotNull() & (F.size("v") == dimensions) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).select(*group, "id", F.col("v").cast("array<double>").alias("v"))
    named = reduce(and_, (F.col(g).isNotNull() for g in group))
    large = written(whole.where(named).groupBy(*group).count().where(F.col("count") > POINTS).select(*group), "large")
    small = whole.where(named).join(large, group, "left_anti")
    held = written(small.groupBy(*group).agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("v")).alias("vs"), F.size(F.collect_set("id")).alias("n")), "groups")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.select(*group).schema)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                row, found = [], []
                for i, (ids, vs) in enumerate(zip(b.column(len(group)).to_pylist(), b.column(len(group) + 1).to_pylist())):
                    mine = diagram(ids, np.array(vs).reshape(-1, dimensions), reach)
                    row += [i] * len(mine)
                    found += mine
                keys = [b.column(j).take(pa.array(row, pa.int64())) for j in range(len(group))]
                values = [pa.array([x[j] for x in found], t) for j, t in enumerate((pa.int32(), pa.float64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([*keys, *values], [*group, "dimension", "birth", "death"])

    solved = held.where(F.col("n") == F.size("ids")).select(*group, "ids", "vs").mapInArrow(solve, f"{types}, dimension int, birth double, death double")
    others = large.unionByName(held.where(F.col("n") < F.size("ids")).select(*group))
    rest = written(whole.join(others, group, "left_semi").unionByName(whole.where(~named)), "rest")
    return solved if rest.isEmpty() else solved.unionByName(large_persistence(rest, group, dimensions, reach))


def large_persistence(points: DataFrame, group: list[str], dimensions: int, reach: float) -> DataFrame:
    """``persistence`` of groups of any size.

    Components are found in Spark at any size.  Loops lie within a component of the whole complex, so each of these is a part that one task
    reduces; a part of over MAX_SIMPLICES is refused.  A group of one point has one component.
    """
    edges = written(rips_edges(points, group, dimensions, reach), "rips")
    forest = spanning_forest(edges, group)
    key = lambda c: F.struct(*group, F.col(c).alias("id"))
    ids = points.where(F.col("id").isNotNull() & (F.size("v") == dimensions) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).select(*group, "id").distinct()
    inner = forest.groupBy(*group).agg(F.count("*").alias("joined")) if group else forest.agg(F.count("*").alias("joined"))
    counts = ids.groupBy(*group).agg(F.count("*").alias("points")) if group else ids.agg(F.count("*").alias("points"))
    both = counts.join(inner, group, "left") if group else counts.join(F.broadcast(inner))  # one row each
    rest = F.col("points") - F.coalesce("joined", F.lit(0))
    last = both.where(rest > 0).select(*group, F.explode(F.sequence(F.lit(1).cast("long"), rest)).alias("n"))
    lasting = last.select(*group, F.lit(0).alias("dimension"), F.lit(0.0).alias("birth"), F.lit(None).cast("double").alias("death"))
    merged = forest.select(*group, F.lit(0).alias("dimension"), F.lit(0.0).alias("birth"), F.col("length").alias("death"))
    part = components(edges.select(key("a").alias("src"), key("b").alias("dst"))).select(F.col("node").alias("na"), F.col("component").alias("part"))
    placed = edges.join(part, key("a") == F.col("na")).select("part", F.struct("a", "b", "length").alias("e"))
    parts = placed.groupBy("part").agg(F.collect_list("e").alias("edges"), F.count("*").alias("n")).where("n > 3")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.select(*group).schema)

    def reduced(batches):
        import pandas as pd

        for b in batches:
            for _, r in b.iterrows():
                found = loops([(e["a"], e["b"], e["length"]) for e in r["edges"]])
                yield pd.DataFrame({**{g: [r["part"][g]] * len(found) for g in group}, "dimension": [1] * len(found), "birth": [x for x, _ in found], "death": [y for _, y in found]}, dtype=object)

    looped = parts.select("part", "edges").mapInPandas(reduced, f"{types}{', ' if types else ''}dimension int, birth double, death double")
    return lasting.unionByName(merged).unionByName(looped)
