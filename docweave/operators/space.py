"""Exact nearest neighbours by ranges of a k-d split, with a second round only where the first one's bound asks for it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.operators.graphs import written

#: Points that the splits are chosen from; any choice gives exact results.
SAMPLE = 20_000
LEAF = 4096
#: Leaves at most: the split goes to every task.
MAX_LEAVES = 1 << 14


class Split:
    """A k-d tree over a sample: the box of each leaf, all boxes together being the whole space."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.low, self.high = [], []
        size = sample.shape[1]
        self._cut(sample, leaves, np.full(size, -np.inf), np.full(size, np.inf))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _cut(self, points: np.ndarray, leaves: int, low: np.ndarray, high: np.ndarray) -> None:
        axis = int(np.ptp(points, axis=0).argmax()) if len(points) else 0
        at = float(np.median(points[:, axis])) if len(points) else 0.0
        if leaves < 2 or len(points) < 2 or not points[:, axis].min() < at:
            self.low.append(low)
            self.high.append(high)
            return
        left, right = high.copy(), low.copy()
        left[axis] = right[axis] = at
        self._cut(points[points[:, axis] < at], leaves // 2, low, left)
        self._cut(points[points[:, axis] >= at], leaves - leaves // 2, right, high)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each point: low edges belong to a box, high ones do not."""
        inside = np.stack([((x >= a) & (x < b)).all(axis=1) for a, b in zip(self.low, self.high)])
        return inside.argmax(axis=0)

    def near(self, x: np.ndarray, bound: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows whose ball of squared radius ``bound`` meets its box)."""
        for i, (a, b) in enumerate(zip(self.low, self.high)):
            gap = np.maximum(np.maximum(a - x, x - b), 0.0)
            rows = np.flatnonzero((gap**2).sum(axis=1) <= bound)
            if len(rows):
                yield i, rows


def vectors_of(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def nearest(points: DataFrame, queries: DataFrame, k: int, dimensions: int, leaf: int = LEAF) -> DataFrame:
    """(query_id, rank, id, distance, candidates): each query's ``k`` nearest points by Euclidean distance, all if there are fewer.

    points: (id, v), queries: (query_id, v), v of ``dimensions`` numbers; rows with nulls, other lengths or numbers that are not finite take no
    part.  A query is first held against the points of its own leaf; the k-th of these bounds its ball, and only leaves whose box the
    ball meets are searched in the second round.  Ties go to the smaller id.  ``candidates``: points the query was held against.  A leaf's
    points are cut into chunks of about ``leaf``, so points at one place do not meet in one task.
    """
    spark = points.sparkSession
    whole = lambda df, key: df.select(F.col(key).alias(key), F.col("v").cast("array<double>").alias("v")).where(F.col(key).isNotNull() & (F.size("v") == dimensions) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    p, q = written(whole(points, "id"), "points"), written(whole(queries, "query_id"), "queries")
    n = p.count()
    id_type, query_type = (df.schema[c].dataType.simpleString() for df, c in ((p, "id"), (q, "query_id")))
    schema = f"query_id {query_type}, id {id_type}, distance double"
    if not n:
        return spark.createDataFrame([], f"query_id {query_type}, rank int, id {id_type}, distance double, candidates long")
    hashed = F.xxhash64("id")
    sample = p.orderBy(hashed).limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    shared = spark.sparkContext.broadcast(Split(vectors_of(sample), min(MAX_LEAVES, max(1, -(-n // leaf)))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.leaf(vectors_of(b.column(1))).astype(np.int32))], [*b.schema.names, "leaf"])

    placed = written(p.mapInArrow(place, f"id {id_type}, v array<double>, leaf int"), "placed")
    chunks = placed.groupBy("leaf").agg(F.ceil(F.count("*") / leaf).cast("int").alias("chunks"))  # a row for each leaf, at most MAX_LEAVES
    stored = written(placed.join(F.broadcast(chunks), "leaf").withColumn("chunk", F.pmod(hashed, F.col("chunks")).cast("int")), "stored")

    def scan(members, asked):
        import pandas as pd

        out = {"query_id": [], "id": [], "distance": []}
        if len(members) and len(asked):
            x, ids = np.stack(members["v"].to_numpy()), members["id"].to_numpy()
            for query, v in zip(asked["query_id"], asked["v"]):
                d = np.sqrt(((x - v) ** 2).sum(axis=1))
                best = np.lexsort((ids, d))[:k]
                out["query_id"] += [query] * len(best)
                out["id"] += ids[best].tolist()
                out["distance"] += d[best].tolist()
        return pd.DataFrame(out, dtype=object).astype({"distance": "float64"})

    def search(asked: DataFrame) -> DataFrame:
        """asked: (query_id, v, leaf)."""
        each = asked.join(F.broadcast(chunks), "leaf").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        return stored.groupBy("leaf", "chunk").cogroup(each.groupBy("leaf", "chunk")).applyInPandas(scan, schema)

    def merged(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("rank") <= k)

    own = q.mapInArrow(place, f"query_id {query_type}, v array<double>, leaf int")
    kept = written(merged(search(own)), "kept")
    bound = kept.groupBy("query_id").agg(F.when(F.count("*") == k, F.max("distance")).alias("bound"))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = vectors_of(b.column(1))
            limit = np.array([np.inf if d is None else (d * (1 + 1e-12)) ** 2 for d in b.column(2).to_pylist()])
            home = shared.value.leaf(x)
            for i, rows in shared.value.near(x, limit):
                rows = pa.array(rows[home[rows] != i])
                if len(rows):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(np.full(len(rows), i, dtype=np.int32))], ["query_id", "v", "leaf"])

    again = q.join(bound, "query_id", "left").select("query_id", "v", "bound").mapInArrow(reach, f"query_id {query_type}, v array<double>, leaf int")
    count = placed.groupBy("leaf").agg(F.count("*").alias("n"))
    touched = own.select("query_id", "leaf").unionByName(again.select("query_id", "leaf")).join(F.broadcast(count), "leaf").groupBy("query_id").agg(F.sum("n").alias("candidates"))
    best = merged(kept.drop("rank").unionByName(search(again)))
    return best.join(touched, "query_id").select("query_id", "rank", "id", "distance", "candidates")
