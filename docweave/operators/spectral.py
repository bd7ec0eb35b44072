"""Clusters of graphs by eigenvectors of a sparse Laplacian, and distributed k-means.

No matrix of nodes by nodes is laid out: block power iteration multiplies the edges with as many columns as clusters are asked for (and a few more).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.operators.factors import EPS, matrices, orthonormal, product, signs, transformed, triangular
from docweave.operators.graphs import written

#: Nodes that all edges may lead to for the rounds to be taken without the edges.
TARGETS = 64


def laplacian_vectors(edges: DataFrame, k: int, oversample: int = 4, rounds: int = 60, tolerance: float = 1e-9, seed: int = 3) -> tuple[np.ndarray, DataFrame]:
    """(the k smallest eigenvalues of the normalised Laplacian, rising; their vectors as (id, v)), of an undirected graph.

    edges: (src, dst, weight); both directions add up, weights that are not positive and loops do not count, nodes without edges are left out.
    Iterates with (I + D^-1/2 W D^-1/2) / 2, whose eigenvalues lie in [0, 1], until none of the k moves by more than ``tolerance``.
    Where all edges lead to one of a few nodes that have none outwards, see ``few_targets``.
    """
    e = edges.where("weight > 0 AND src != dst").select("src", "dst", "weight")
    width = min(k + oversample, 63)
    if dict(e.dtypes)["src"] == dict(e.dtypes)["dst"]:
        e = written(e.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "summed")
        targets = sorted(r.dst for r in e.select("dst").distinct().limit(TARGETS + 1).collect())
        if 0 < len(targets) <= TARGETS and e.where(F.col("src").isin(targets)).isEmpty():
            return few_targets(e, targets, k, width, rounds, tolerance, seed)
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    both = written(both, "both")
    degree = both.groupBy("src").agg(F.sum("w").alias("d"))
    of = degree.withColumnRenamed("src", "dst").withColumnRenamed("d", "dd")
    scaled = both.join(degree, "src").join(of, "dst").select(F.col("src").alias("row"), F.col("dst").alias("col"), (F.col("w") / F.sqrt(F.col("d") * F.col("dd")) / 2).alias("value"))
    loops = degree.select(F.col("src").alias("row"), F.col("src").alias("col"), F.lit(0.5).alias("value"))
    m = written(scaled.unionByName(loops), "laplacian")
    q, _, n = orthonormal(written(degree.select(F.col("src").alias("id"), F.array(*signs(F.col("src"), width, seed)).alias("v")), "start"), width)
    last, c = np.zeros(0), np.zeros((0, 0))
    for _ in range(rounds):
        if not n:
            break
        q, c, n = orthonormal(written(product(m, q, n, on="col", by="row"), "product"), n)
        s = np.linalg.svd(c, compute_uv=False)[:k]
        if len(s) == len(last) and np.abs(s - last).max() <= tolerance:
            break
        last = s
    if not n:
        return np.zeros(0), written(q, "vectors")
    # rotate the basis to eigenvectors: Q'MQ is as small as the block
    both_sides = written(product(m, q, n, on="col", by="row"), "product").select("id", F.col("v").alias("mv")).join(q, "id")
    cells = both_sides.agg(*(F.sum(F.col("v")[i] * F.col("mv")[j]).alias(f"h{i}_{j}") for i in range(n) for j in range(n))).first()
    h = np.array(list(cells)).reshape(n, n)
    values, vectors = np.linalg.eigh((h + h.T) / 2)
    order = np.argsort(-values)[:k]
    return 2 - 2 * values[order], written(transformed(q, vectors[:, order]), "vectors")


def few_targets(e: DataFrame, targets: list, k: int, width: int, rounds: int, tolerance: float, seed: int) -> tuple[np.ndarray, DataFrame]:
    """``laplacian_vectors`` of edges (src, dst, weight), one of a kind, from any number of nodes to a few others.

    With B the scaled weights, a row for each source, and S its start, the sources' part of every round is S X + B Y: the others have as many rows as
    there are targets.  So the same rounds are taken in the coordinates of one QR of (S, B), by X, Y and the targets' part, and no round reads the edges.
    """
    spark, m = e.sparkSession, len(targets)
    number = {t: j for j, t in enumerate(targets)}
    sums = e.groupBy("dst").agg(F.sum("weight").alias("d")).collect()  # one for each target
    reach = np.ones(m)
    for r in sums:
        reach[number[r.dst]] = r.d
    weights = [F.coalesce(F.sum(F.when(F.col("dst") == F.lit(t), F.col("weight"))), F.lit(0.0)).cast("double").alias(f"w{j}") for j, t in enumerate(targets)]
    each = e.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("d"), *weights)
    scaled = [F.col(f"w{j}") / F.sqrt(F.col("d") * F.lit(float(reach[j]))) for j in range(m)]
    rows = written(each.select("id", F.array(*signs(F.col("id"), width, seed), *scaled).alias("v")), "sources")
    r = triangular(rows, width + m)  # isometric to the sources' rows
    b = r[:, width:]
    start = spark.createDataFrame([(t,) for t in targets], f"id {dict(e.dtypes)['dst']}").select("id", F.array(*signs(F.col("id"), width, seed)).alias("v")).collect()
    low = np.zeros((m, width))
    for x in start:
        low[number[x.id]] = x.v

    def basis(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(T, C): P T is orthonormal and P = (P T) C, as ``orthonormal`` has it for a table."""
        _, s, vt = np.linalg.svd(np.linalg.qr(p, mode="r"))
        rank = int((s > p.shape[1] * EPS * 8 * s[0]).sum())
        turn = vt[:rank].T / s[:rank]
        again = np.linalg.qr(p @ turn, mode="r")
        return turn @ np.linalg.inv(again), again @ (s[:rank, None] * vt[:rank])

    def stack(c: np.ndarray, low: np.ndarray) -> np.ndarray:
        return np.vstack([r @ c, low])

    c = np.vstack([np.eye(width), np.zeros((m, width))])  # sources' part: (S, B) c
    turn, _ = basis(stack(c, low))
    c, low, last = c @ turn, low @ turn, np.zeros(0)
    step = lambda c, low: (np.vstack([c[:width] / 2, (c[width:] + low) / 2]), (low + b.T @ (r @ c)) / 2)
    for _ in range(rounds):
        c, low = step(c, low)
        turn, factor = basis(stack(c, low))
        c, low = c @ turn, low @ turn
        s = np.linalg.svd(factor, compute_uv=False)[:k]
        if len(s) == len(last) and np.abs(s - last).max() <= tolerance:
            break
        last = s
    h = stack(c, low).T @ stack(*step(c, low))
    values, vectors = np.linalg.eigh((h + h.T) / 2)
    order = np.argsort(-values)[:k]
    ends = spark.createDataFrame([(t, [float(x) for x in low[number[t]] @ vectors[:, order]]) for t in targets], f"id {dict(e.dtypes)['dst']}, v array<double>")
    return 2 - 2 * values[order], written(transformed(rows, c @ vectors[:, order]).unionByName(ends), "vectors")


def unit_rows(dense: DataFrame) -> DataFrame:
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return dense.withColumn("size", size).select("id", F.when(F.col("size") > 0, F.transform("v", lambda x: x / F.col("size"))).otherwise(F.col("v")).alias("v"))


def distance_to(centre: np.ndarray) -> Column:
    return F.aggregate(F.zip_with("v", F.array(*map(F.lit, map(float, centre))), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)


def k_means(dense: DataFrame, k: int, rounds: int = 50) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance), centres): Lloyd's rounds until no centre moves.  The first centre is the row of smallest id; each next one the row
    farthest from all before it (ties: smaller id); so it needs no luck, and fewer distinct rows than k give fewer clusters.

    Centres are broadcast; tasks return one sum for each.
    """
    rows = written(dense.select("id", "v"), "rows")
    first = rows.orderBy("id").first()
    id_type = rows.schema["id"].dataType.simpleString()
    if first is None:
        return dense.sparkSession.createDataFrame([], f"id {id_type}, cluster int, distance double"), np.zeros((0, 0))
    centres = [np.array(first.v, dtype=float)]
    while len(centres) < k:
        near = F.least(*(distance_to(c) for c in centres)) if len(centres) > 1 else distance_to(centres[0])
        far = rows.select(F.col("v"), F.round(near, 12).alias("d"), "id").orderBy(F.desc("d"), "id").first()
        if far.d <= 0:
            break
        centres.append(np.array(far.v, dtype=float))
    now = np.array(centres)

    def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.stack([((x - one) ** 2).sum(axis=1) for one in c])
        return d.argmin(axis=0), d.min(axis=0)

    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], c: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros_like(c), np.zeros(len(c), dtype=np.int64)
            for _, x in matrices(batches, 0):
                at, _ = nearest(x, c)
                np.add.at(total, at, x)
                count += np.bincount(at, minlength=len(c))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(c), dtype=np.int32)), pa.array(count), pa.array(list(total))], ["cluster", "n", "total"])

        parts = rows.select("v").mapInArrow(sums, "cluster int, n long, total array<double>")
        width = now.shape[1]
        merged = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[j]).alias(f"t{j}") for j in range(width))).collect()  # one for each cluster
        moved = now.copy()
        for r in merged:
            if r.n:
                moved[r.cluster] = [r[f"t{j}"] / r.n for j in range(width)]
        done = np.abs(moved - now).max() <= 1e-12
        now = moved
        if done:
            break

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in matrices(batches, 1):
            at, d = nearest(x, now)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(at.astype(np.int32)), pa.array(d)], ["id", "cluster", "distance"])

    return rows.mapInArrow(assign, f"id {id_type}, cluster int, distance double"), now


def spectral_clusters(edges: DataFrame, k: int, **how) -> DataFrame:
    """(node, cluster): k-means over the nodes' unit rows in the Laplacian's first k eigenvectors; clusters are numbered by their smallest node."""
    _, vectors = laplacian_vectors(edges, k, **how)
    found, _ = k_means(unit_rows(vectors), k)
    first = found.groupBy("cluster").agg(F.min("id").alias("first")).withColumn("number", F.row_number().over(Window.orderBy("first")) - 1)  # k rows
    return found.join(F.broadcast(first), "cluster").select(F.col("id").alias("node"), F.col("number").alias("cluster"))


def passed_on(e: DataFrame, now: DataFrame) -> DataFrame:
    """(node, got): what nodes (node, x) give along edges (src, dst, w).  Joins are by sorted shuffles: a broadcast would lead all nodes
    through the driver in each round."""
    got = e.join(now.hint("merge"), e.src == now.node).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("w") * F.col("x")).alias("got"))
    return got.hint("merge")


def eigenvector_centrality(edges: DataFrame, directed: bool = True, rounds: int = 200, tolerance: float = 1e-6) -> DataFrame:
    """(node, centrality): of unit length, in proportion to the sum of the nodes that point at it (all neighbours if not ``directed``).

    Each round adds to a node what the last one gave its neighbours, which is power iteration with the identity added, so two-sided graphs
    settle too; it ends when the changes sum to less than ``tolerance`` a node.  Repeated edges add up; a node without any has none.
    """
    e = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst", "weight")
    if not directed:
        e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    e = written(e.groupBy("src", "dst").agg(F.sum("weight").alias("w")), "edges")
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    n = nodes.count()
    now = written(nodes.withColumn("x", F.lit(1.0 / max(1, n))), "centrality")
    for _ in range(rounds):
        raw = written(now.join(passed_on(e, now), "node", "left").select("node", F.col("x").alias("old"), (F.col("x") + F.coalesce("got", F.lit(0.0))).alias("x")), "raw")
        size = raw.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0]
        if not size:
            break
        moved = raw.agg(F.sum(F.abs(F.col("x") / size - F.col("old")))).first()[0]
        now = raw.select("node", (F.col("x") / size).alias("x"))
        if moved < n * tolerance:
            break
    return now.select("node", F.col("x").alias("centrality"))


def bipartition(edges: DataFrame, **how) -> tuple[float, DataFrame]:
    """(second eigenvalue of the Laplacian, (node, side)): the graph cut by the signs of the second eigenvector; side 0 holds the smallest node."""
    values, vectors = laplacian_vectors(edges, 2, **how)
    if len(values) < 2:
        return 0.0, vectors.select(F.col("id").alias("node"), F.lit(0).alias("side"))
    signed = vectors.select(F.col("id").alias("node"), (F.col("v")[1] < 0).alias("negative"))
    first = signed.orderBy("node").first()
    return float(values[1]), signed.select("node", (F.col("negative") != F.lit(first.negative)).cast("int").alias("side"))
