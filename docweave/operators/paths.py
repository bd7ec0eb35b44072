"""Paths, hops and centralities of directed graphs given as edges (src, dst, edge_type, weight)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.operators.graphs import nodes, written


def shortest_paths(edges: DataFrame, source: str, weighted: bool) -> DataFrame:
    """(node, cost, path) of every node that ``source`` reaches: the least cost, then the first path in order.

    Rounds of relaxation: only nodes that improved pass their paths on; lineage is cut each round.
    """
    cost = F.col("weight") if weighted else F.lit(1.0)
    e = written(edges.groupBy("src", "dst").agg(F.min(cost).alias("w")), "steps")
    best = edges.sparkSession.createDataFrame([(source, 0.0, [source])], "node string, cost double, path array<string>")
    moved = best
    while True:
        more = moved.join(e, moved.node == e.src).select(F.col("dst").alias("node"), F.round(F.col("cost") + F.col("w"), 9).alias("cost"), F.concat("path", F.array("dst")).alias("path"))
        every = best.withColumn("old", F.lit(True)).unionByName(more.withColumn("old", F.lit(False)))
        least = every.groupBy("node").agg(F.min(F.struct("cost", "path", F.col("old").cast("int").alias("o"))).alias("m"), F.max("old").alias("known"), F.min(F.when(F.col("old"), F.struct("cost", "path"))).alias("was"))
        now = least.select("node", "m.cost", "m.path", (F.col("was").isNull() | (F.struct("m.cost", "m.path") < F.struct("was.cost", "was.path"))).alias("better"))
        now = written(now, "paths")
        moved = now.where("better").select("node", "cost", "path")
        best = now.select("node", "cost", "path")
        if moved.isEmpty():
            return best


def hops(edges: DataFrame, sources: DataFrame, depth: int) -> DataFrame:
    """(source, node, hops): the fewest edges from each source, up to ``depth``; the source itself at 0."""
    e = written(edges.select("src", "dst").distinct(), "steps")
    seen = sources.select(F.col("node").alias("source"), "node").withColumn("hops", F.lit(0))
    front = seen
    for i in range(1, depth + 1):
        more = front.join(e, front.node == e.src).select("source", F.col("dst").alias("node")).distinct()
        front = written(more.join(seen, ["source", "node"], "left_anti").withColumn("hops", F.lit(i)), "front")
        if front.isEmpty():
            break
        seen = written(seen.unionByName(front), "seen")
    return seen


def relationships(edges: DataFrame, source: DataFrame, depth: int) -> DataFrame:
    """(edge_type, n, weight): edges that leave nodes fewer than ``depth`` hops away, by type."""
    inner = hops(edges, source, depth - 1).select(F.col("node").alias("src")).distinct()
    return edges.join(inner, "src", "left_semi").groupBy("edge_type").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """(neighbour, direction): successors, and predecessors that are none."""
    out = edges.where(F.col("src") == node).select(F.col("dst").alias("neighbour")).distinct()
    into = edges.where(F.col("dst") == node).select(F.col("src").alias("neighbour")).distinct()
    return out.withColumn("direction", F.lit("out")).unionByName(into.join(out, "neighbour", "left_anti").withColumn("direction", F.lit("in")))


def induced(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges both of whose ends are kept (a column ``node``)."""
    return edges.join(keep.select(F.col("node").alias("src")), "src", "left_semi").join(keep.select(F.col("node").alias("dst")), "dst", "left_semi")


def alike(edges: DataFrame, node: str) -> DataFrame:
    """(node, similarity): Jaccard of successor sets; only nodes that share a successor are paired, the others are 0."""
    e = edges.select("src", "dst").distinct()
    sizes = e.groupBy("src").agg(F.count("*").alias("n"))
    mine = e.where(F.col("src") == node).select("dst")
    size = mine.count()
    shared = e.join(F.broadcast(mine) if size < 10_000 else mine, "dst", "left_semi").groupBy("src").agg(F.count("*").alias("both"))
    j = nodes(edges).where(F.col("node") != node).join(sizes, F.col("node") == sizes.src, "left").drop("src").join(shared, F.col("node") == shared.src, "left")
    both = F.coalesce("both", F.lit(0))
    union = F.coalesce("n", F.lit(0)) + F.lit(size) - both
    return j.select("node", F.when(union > 0, both / union).otherwise(0.0).alias("similarity"))


def diffused(edges: DataFrame, seeds: DataFrame, teleport: float, rounds: int) -> DataFrame:
    """(node, score): teleport x seeds + (1 - teleport) x the share passed along weighted edges; mass without a way on is lost."""
    total = edges.groupBy("src").agg(F.sum("weight").alias("t"))
    share = written(edges.join(total, "src").where("t > 0").select("src", "dst", (F.col("weight") / F.col("t")).alias("p")), "shares")
    n = seeds.count()
    passed = seeds.select("node", F.lit(teleport / max(1, n)).alias("score"))
    out = passed
    # the series seeds, one step on, two steps on, ...: each term moves once
    for _ in range(rounds):
        passed = passed.join(share, passed.node == share.src).groupBy(F.col("dst").alias("node")).agg(F.sum((1 - teleport) * F.col("score") * F.col("p")).alias("score"))
        passed = written(passed, "passed")
        if passed.isEmpty():
            break
        out = out.unionByName(passed)
    return out.groupBy("node").agg(F.sum("score").alias("score"))


def betweenness(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """Shortest paths through each node of a directed graph, ends left out: one search and one walk back for each source."""
    order = np.argsort(src, kind="stable")
    to, first = dst[order], np.searchsorted(src[order], np.arange(n + 1))
    out = np.zeros(n)
    for s in range(n):
        far, ways, visited = np.full(n, -1), np.zeros(n), [s]
        far[s], ways[s], i = 0, 1, 0
        before: list[list[int]] = [[] for _ in range(n)]
        while i < len(visited):
            v = visited[i]
            i += 1
            for w in to[first[v] : first[v + 1]].tolist():
                if far[w] < 0:
                    far[w] = far[v] + 1
                    visited.append(w)
                if far[w] == far[v] + 1:
                    ways[w] += ways[v]
                    before[w].append(v)
        rest = np.zeros(n)
        for w in reversed(visited):
            for v in before[w]:
                rest[v] += ways[v] / ways[w] * (1 + rest[w])
            if w != s:
                out[w] += rest[w]
    return out


def closeness(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """(reaching / (n - 1)) x (reaching / their distances in sum), over the nodes that reach each one."""
    order = np.argsort(dst, kind="stable")
    back, first = src[order], np.searchsorted(dst[order], np.arange(n + 1))
    out = np.zeros(n)
    for s in range(n):
        far, visited, i = {s: 0}, [s], 0
        while i < len(visited):
            v = visited[i]
            i += 1
            for w in back[first[v] : first[v + 1]].tolist():
                if w not in far:
                    far[w] = far[v] + 1
                    visited.append(w)
        total = sum(far.values())
        out[s] = (len(far) - 1) ** 2 / total / (n - 1) if total and n > 1 else 0.0
    return out


def centralities(edges: DataFrame, part: Column) -> DataFrame:
    """(part, node, betweenness, closeness) within each part of the graph.  Both need every shortest path of a part, so parts are
    bounded subgraphs (a component, a document), each in one Arrow group; parts run apart."""

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        names, ends = np.unique(pdf[["src", "dst"]].to_numpy().astype(str), return_inverse=True)
        pairs = np.unique(ends.reshape(-1, 2), axis=0)
        src, dst, n = pairs[:, 0], pairs[:, 1], len(names)
        return pd.DataFrame({"part": pdf["part"].iloc[0], "node": names, "betweenness": betweenness(src, dst, n), "closeness": closeness(src, dst, n)})

    return edges.select(part.alias("part"), "src", "dst").groupBy("part").applyInPandas(measure, "part string, node string, betweenness double, closeness double")
