"""Approximate nearest neighbours by an adaptive dimension scan over inverted lists.

Vectors are rotated by a fixed random rotation and stored in lists around trained centroids, as blocks of columns.  A query
scans the lists nearest to it block by block: after each block of dimensions, the partial distance, scaled up to all
dimensions, is a sample of the full one, and a hypothesis test (the bound ``1 + EPSILON / sqrt(d)``) drops candidates that would
hardly enter the best k.  What is left is measured exactly on the original vectors.

Centroids are fitted on a bounded sample; every vector is indexed.  Long lists are cut into chunks of at most ``CHUNK`` vectors
(on average), which are scanned apart and merged, so no list, however hot, meets in one task; nor do all queries: they come in
blocks of ``QUERIES`` (on average), each of which meets every chunk that it probes.  A query probes lists until they
hold ``probe_share`` of all vectors and at least ``LEAST_PER_K`` x k of them.  The default share is high because vectors that
form no clusters spread their neighbours over most lists; a smaller one serves clustered vectors.

Edge cases: null and zero vectors, and those holding null or non-finite components, take no part, nor do vectors whose length
differs from the commonest.  Ties go to the smaller id; repeated vectors stay apart by id.  Fewer candidates than k give all.
A query is never its own neighbour; rows with null ids take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import materialize, share_of

SAMPLE = 20_000
CHUNK = 4096
QUERIES = 4096
BLOCK = 16
EPSILON = 2.1
PROBE_SHARE = 0.75
LEAST_PER_K = 4
MAX_LISTS = 4096


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.RandomState(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)[None, :], 0)


def fit_centroids(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's iterations from evenly spaced distinct members."""
    centres = np.unique(x, axis=0)
    centres = centres[np.linspace(0, len(centres) - 1, min(n, len(centres))).astype(int)]
    for _ in range(rounds):
        nearest = np.concatenate([distances(x[i : i + 2048], centres).argmin(1) for i in range(0, len(x), 2048)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        n_in = np.bincount(nearest, minlength=len(centres))
        centres = np.where(n_in[:, None] > 0, sums / np.maximum(n_in, 1)[:, None], centres)
    return centres


def adaptive_scan(query: np.ndarray, turned: np.ndarray, columns: list[np.ndarray], original: np.ndarray, ids: np.ndarray, own: int, k: int) -> list[tuple[int, float]]:
    """The best k of one chunk.  columns: blocks of rotated dimensions, each (dimensions, vectors)."""
    n, dim = len(ids), len(turned)
    alive = np.flatnonzero(ids != own)
    if len(alive) > 4 * k:
        # a first bound from a spread of candidates, measured fully; the k-th best of all can only be nearer
        probe = alive[np.linspace(0, len(alive) - 1, 4 * k).astype(int)]
        bound = np.partition(((original[probe] - query) ** 2).sum(1), k - 1)[k - 1]
        partial, seen = np.zeros(n), 0
        slack = 1e-9 * float(query @ query)  # rotation rounds: equal vectors must not be told apart
        for block in columns:
            part = block[:, alive] if len(alive) < n else block
            partial[alive] += ((part - turned[seen : seen + len(block), None]) ** 2).sum(0)
            seen += len(block)
            if seen < dim:
                keep = partial[alive] * (dim / seen) <= bound * (1 + EPSILON / np.sqrt(seen)) ** 2 + slack
                alive = alive[keep]
                if len(alive) > 8 * k:  # the bound tightens with what looks nearest so far
                    near = alive[np.argpartition(partial[alive], 2 * k)[: 2 * k]]
                    bound = min(bound, np.partition(((original[near] - query) ** 2).sum(1), k - 1)[k - 1])
        alive = alive[partial[alive] <= bound * (1 + 1e-9) + slack]
        if len(alive) < k:
            alive = np.union1d(alive, probe)
    exact = np.sqrt(((original[alive] - query) ** 2).sum(1))
    order = np.lexsort((ids[alive], exact))[:k]
    return [(int(ids[alive[i]]), float(exact[i])) for i in order]


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id long, v array<double>) of the vectors that take part."""
    v = F.col(vector_column).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    out = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    size = out.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    return out.where(F.size("v") == (size.n if size else 0))


class Index:
    """Rotation and centroids; lists are assigned where the vectors are."""

    def __init__(self, sample: np.ndarray, rows: int):
        self.turn = rotation(sample.shape[1])
        self.centres = fit_centroids(sample @ self.turn, int(np.clip(np.sqrt(rows) / 2, 1, MAX_LISTS)))

    def lists(self, turned: np.ndarray) -> np.ndarray:
        return distances(turned, self.centres).argmin(1)


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1).astype(np.float64)


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", probe_share: float = PROBE_SHARE, query_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` (over ``vec_id``) holds, the nearest others."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    every = usable(vectors, id_column, vector_column)
    rows = every.count()
    if not rows:
        return spark.createDataFrame([], schema)
    share = min(1.0, 1.2 * SAMPLE / rows)
    hashed = share_of("vec_id", F.lit("centroids"))
    sample = every.where(hashed < share).orderBy(hashed).limit(SAMPLE).select("v").toArrow()
    if not sample.num_rows:
        sample = every.limit(1).select("v").toArrow()
    shared = spark.sparkContext.broadcast(Index(matrix(sample.column("v").combine_chunks()), rows))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.lists(matrix(b.column(1)) @ shared.value.turn).astype(np.int32))], ["vec_id", "v", "list"])

    placed = materialize(every.mapInArrow(assign, "vec_id long, v array<double>, list int"), "lists")
    sizes = np.zeros(len(shared.value.centres), dtype=np.int64)
    for r in placed.groupBy("list").agg(F.count("*").alias("n")).collect():  # a row for each list, at most MAX_LISTS
        sizes[r.list] = r.n
    chunks = np.maximum(1, -(-sizes // CHUNK))
    plan = spark.sparkContext.broadcast((sizes, chunks))
    least = max(probe_share * rows, min(rows, LEAST_PER_K * k))

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_in, parts = plan.value
        for b in batches:
            if not b.num_rows:
                continue
            d = distances(matrix(b.column(1)) @ shared.value.turn, shared.value.centres)
            for i in range(b.num_rows):
                order = np.argsort(d[i], kind="stable")
                lists = order[: int(np.searchsorted(np.cumsum(n_in[order]), least)) + 1]
                lists = lists[n_in[lists] > 0]
                each = [(int(c), j) for c in lists for j in range(parts[c])]
                one = b.slice(i, 1)
                index = pa.array(np.zeros(len(each), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([one.column(0).take(index), one.column(1).take(index), pa.array([c for c, _ in each], pa.int32()), pa.array([j for _, j in each], pa.int32())], ["query_id", "q", "list", "chunk"])

    queries = placed.where(is_query).select("vec_id", "v").mapInArrow(probes, "query_id long, q array<double>, list int, chunk int")
    of_list = F.element_at(F.array(*(F.lit(int(c)) for c in chunks)), F.col("list") + 1) if len(chunks) <= 512 else None
    if of_list is None:
        small = spark.createDataFrame(pd.DataFrame({"list": np.arange(len(chunks), dtype=np.int32), "parts": chunks.astype(np.int32)}), "list int, parts int")
        stored = placed.join(F.broadcast(small), "list").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    else:
        stored = placed.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), of_list).cast("int"))

    def scan(members: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if members.empty or asked.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        original, ids = np.stack(members["v"].to_numpy()).astype(np.float64), members["vec_id"].to_numpy()
        turned = original @ shared.value.turn
        columns = [np.ascontiguousarray(turned[:, i : i + BLOCK].T) for i in range(0, turned.shape[1], BLOCK)]
        out = [(q, *x) for q, v in zip(asked["query_id"], asked["q"]) for v in [np.asarray(v, dtype=np.float64)] for x in adaptive_scan(v, v @ shared.value.turn, columns, original, ids, q, k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    blocks = max(1, -(-placed.where(is_query).count() // query_block))
    if blocks > 1:  # every chunk goes to each block of queries
        queries = queries.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit("block")), F.lit(blocks)).cast("int"))
        stored = stored.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["list", "chunk", "block"] if blocks > 1 else ["list", "chunk"]
    found = stored.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(scan, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
