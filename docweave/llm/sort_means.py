"""Centroid clustering by sort-means, exact over integers.

Components become floor(scale * c).  Centroids start as the vectors of smallest sha256 of "<seed>:<id>".  In each round the driver orders,
for each centroid, all others by their distance from it, and broadcasts that.  A vector is held against the centroid of its last
assignment first, then against the others in the order of that centroid, and stops at the first one strictly beyond twice its
current distance: by the triangle inequality neither that one nor a later one can be nearer, or as near.  A task does this for all
its vectors of one last assignment at once; those still searching are always the ones farthest from it, so each step works on a
shrinking prefix.  Sums per centroid are taken within the tasks before they are merged, so a cluster, however large, never
meets in one task.  Each round's assignments are written to the shared folder.

Distances are squared and whole numbers throughout; ties go to the smaller number.  A centroid's new component is the
exact floor of the mean; one without vectors stays.

Edge cases: vectors that are null, of another length, or hold null, NaN, infinite or |scale * c| >= 2**62 components take no part.  Fewer
vectors than centroids give as many centroids as vectors.  Repeated rows count each; of rows of one id the smaller vector starts
a centroid first; a null id is hashed as "null".  An empty table gives an empty result.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import materialize

DIMENSIONS = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
SEED = 1
#: Rows of a step: distances to one centroid at a time need so many rows of memory.
STEP = 4096
#: The driver and every task hold distances between all centroids.
MAX_CENTROIDS = 4096


def integers(vectors: DataFrame, id_column: str, vector_column: str, dimensions: int, scale: int) -> DataFrame:
    """(vec_id, x array<long>) of the vectors that take part."""
    c = F.col(vector_column).cast("array<double>")
    usable = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * F.lit(float(scale))) < F.lit(float(1 << 62))))
    rows = vectors.select(F.col(id_column).alias("vec_id"), c.alias("c")).where(F.col("c").isNotNull() & (F.size("c") == dimensions) & usable)
    return rows.select("vec_id", F.transform("c", lambda v: F.floor(v * F.lit(float(scale))).cast("long")).alias("x"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    return np.array([r.x for r in rows.select(mark.alias("mark"), "x").orderBy("mark", "x").limit(k).collect()], dtype=np.int64)


def wide(*parts: np.ndarray) -> type:
    """Machine numbers if these hold any squared distance between the parts' rows, else Python's."""
    reach = max((abs(int(v)) for p in parts if p.size for v in (p.min(), p.max())), default=0)
    return np.int64 if (2 * reach) ** 2 * max(p.shape[1] for p in parts) < 1 << 60 else object


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


class Order:
    """Centroids, and for each the others by distance from it."""

    def __init__(self, centroids: np.ndarray):
        kind = wide(centroids)
        c = centroids.astype(kind)
        self.centroids = centroids
        between = [squared(c, one) for one in c]
        self.others = [np.array(sorted((j for j in range(len(c)) if j != i), key=lambda j: (between[i][j], j)), dtype=np.int64) for i in range(len(c))]
        self.between = [between[i][o] for i, o in enumerate(self.others)]

    def assign(self, x: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid and squared distance of each row, and how many distances were taken."""
        kind = wide(x, self.centroids)
        x, c = x.astype(kind), self.centroids.astype(kind)
        best, distance, measured = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=kind), 0
        for p in np.unique(last):
            rows = np.flatnonzero(last == p)
            own = squared(x[rows], c[p])
            far = np.argsort(-own, kind="stable")
            rows, own = rows[far], own[far]  # farthest first
            nearest, at = own.copy(), np.full(len(rows), p)
            searching = len(rows)
            measured += searching
            for j, apart in zip(self.others[p], self.between[p]):
                # strictly beyond twice the current distance, both squared
                searching = int(np.searchsorted(-4 * own[:searching], -apart, side="right"))
                if not searching:
                    break
                d = squared(x[rows[:searching]], c[j])
                measured += searching
                better = (d < nearest[:searching]) | ((d == nearest[:searching]) & (j < at[:searching]))
                at[:searching] = np.where(better, j, at[:searching])
                nearest[:searching] = np.where(better, d, nearest[:searching])
            best[rows], distance[rows] = at, nearest
        return best, distance, measured


def assigned(rows: DataFrame, order: Order) -> DataFrame:
    """``rows`` (vec_id, x, cluster) with their new cluster, and the squared distance from it (null where it needs over 38 digits)."""
    shared = rows.sparkSession.sparkContext.broadcast(order)
    id_type = rows.schema["vec_id"].dataType.simpleString()
    most = 10**38

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, STEP):
                part = b.slice(i, STEP)
                x = np.asarray(part.column(1).flatten()).reshape(part.num_rows, -1)
                best, distance, _ = shared.value.assign(x, part.column(2).to_numpy())
                if distance.dtype == object:
                    exact = pa.array([Decimal(d) if d < most else None for d in distance], pa.decimal128(38, 0))
                else:
                    exact = pa.array(distance).cast(pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(best.astype(np.int32)), exact], ["vec_id", "x", "cluster", "distance"])

    return rows.select("vec_id", "x", "cluster").mapInArrow(run, f"vec_id {id_type}, x array<long>, cluster int, distance decimal(38,0)")


def means(rows: DataFrame, before: np.ndarray) -> np.ndarray:
    """Each centroid's exact floor of the mean of its vectors; those without any stay."""
    k, dimensions = before.shape
    half = 31

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, upper, lower = np.zeros(k, dtype=np.int64), np.zeros((k, dimensions), dtype=np.int64), np.zeros((k, dimensions), dtype=np.int64)
        for b in batches:
            if b.num_rows:
                x, at = np.asarray(b.column(0).flatten()).reshape(b.num_rows, -1), b.column(1).to_numpy()
                n += np.bincount(at, minlength=k)
                np.add.at(upper, at, x >> half)
                np.add.at(lower, at, x & ((1 << half) - 1))
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(n[held]), pa.array(list(upper[held]), pa.list_(pa.int64())), pa.array(list(lower[held]), pa.list_(pa.int64()))], ["cluster", "n", "upper", "lower"])

    each = rows.select("x", "cluster").mapInArrow(part, "cluster int, n long, upper array<long>, lower array<long>")
    by_place = each.select("cluster", "n", F.posexplode(F.arrays_zip("upper", "lower")).alias("i", "s"))
    sums = (F.sum(F.col(c).cast("decimal(38,0)")).alias(a) for c, a in (("n", "n"), ("s.upper", "upper"), ("s.lower", "lower")))
    after = before.copy()
    for r in by_place.groupBy("cluster", "i").agg(*sums).collect():  # centroids x dimensions
        after[r.cluster, r.i] = ((int(r.upper) << half) + int(r.lower)) // int(r.n)
    return after


def cluster(
    vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid): a row for each vector that takes part.

    ``distance`` is squared; it and its sums over the cluster and over all are decimal(38,0).
    """
    if centroids > MAX_CENTROIDS:
        raise ValueError(f"{centroids} centroids; at most {MAX_CENTROIDS} are ordered")
    rows = materialize(integers(vectors, id_column, vector_column, dimensions, scale), "integers").withColumn("cluster", F.lit(0))
    now = first_centroids(rows, centroids, seed)
    if not len(now):
        id_type = rows.schema["vec_id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id {id_type}, cluster int, distance decimal(38,0), cluster_inertia decimal(38,0), inertia decimal(38,0), centroid array<long>")
    for _ in range(rounds):
        rows = materialize(assigned(rows, Order(now)).drop("distance"), "round")
        now = means(rows, now)
    last = materialize(assigned(rows, Order(now)).drop("x"), "assigned")
    total = F.sum("distance").cast("decimal(38,0)")
    of_cluster = {r.cluster: r.s for r in last.groupBy("cluster").agg(total.alias("s")).collect()}  # one for each centroid
    table = [(i, of_cluster[i], [int(v) for v in now[i]]) for i in sorted(of_cluster)]
    known = vectors.sparkSession.createDataFrame(table, "cluster int, cluster_inertia decimal(38,0), centroid array<long>")
    inertia = None if any(s is None for s in of_cluster.values()) else sum(of_cluster.values())
    # MAX_CENTROIDS rows at most
    out = last.join(F.broadcast(known), "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(inertia).cast("decimal(38,0)").alias("inertia"), "centroid")


def digest(components: list[int]) -> str:
    """sha256 of a centroid's components in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, components)).encode()).hexdigest()
