"""Factors of matrices too tall for one machine: QR, truncated SVD, and what follows from them.

A *dense* matrix is a table (id, v array<double>) of few columns; a *sparse* one is a table of entries (row, col, value).  Only matrices
as wide as a dense table's columns, squared, reach the driver.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import text as T
from docweave.operators.graphs import parts_for, written

#: Factors that meet in one task of the reduction, and rows of a step.
FAN, STEP = 16, 4096
#: Numbers that a dense table may hold to be sent to all tasks; eight bytes each.
BROADCAST_NUMBERS = 2_000_000
#: Texts packed together, packed bytes that are multiplied at once, rows of words that a task adds up, characters of a block.
TEXTS, PACKED, WORDS, CHARS = 512, 1 << 22, 1 << 20, 500_000_000
EPS = np.finfo(np.float64).eps


def matrices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for i in range(0, b.num_rows, STEP):
            part = b.slice(i, STEP)
            yield part, np.asarray(part.column(column).flatten()).reshape(part.num_rows, -1)


def triangular(dense: DataFrame, width: int) -> np.ndarray:
    """R of the QR factors of all rows: each task's R, reduced as a tree in Spark; diagonal entries are not negative."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for _, m in matrices(batches, 0):
            r = np.linalg.qr(np.vstack([r, m]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.ravel()])], ["part", "r"])

    def reduce(group):
        import pandas as pd

        stacked = np.vstack([np.asarray(r).reshape(-1, width) for r in group.sort_values("part")["r"]])
        return pd.DataFrame({"part": [int(group["part"].min()) // FAN], "r": [np.linalg.qr(stacked, mode="r").ravel()]})

    parts = written(dense.select("v").mapInArrow(local, "part long, r array<double>"), "factors")
    while parts.count() > FAN:
        parts = written(parts.groupBy(F.floor(F.col("part") / FAN).alias("g")).applyInPandas(reduce, "part long, r array<double>"), "factors")
    # at most FAN matrices of width squared
    found = [np.asarray(r.r).reshape(-1, width) for r in parts.orderBy("part").collect()]
    r = np.linalg.qr(np.vstack([np.zeros((width, width)), *found]), mode="r")
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def transformed(dense: DataFrame, by: np.ndarray) -> DataFrame:
    """Each row times the matrix ``by``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, m in matrices(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(m @ by), pa.list_(pa.float64()))], ["id", "v"])

    return dense.select("id", "v").mapInArrow(run, f"id {dense.schema['id'].dataType.simpleString()}, v array<double>")


def independent(r: np.ndarray) -> list[int]:
    """Columns of R that no earlier ones span, as rounding tells."""
    kept: list[int] = []
    basis = np.zeros((len(r), 0))
    floor = len(r) * EPS * max(np.abs(r).max(initial=0.0), np.finfo(np.float64).tiny) * 8
    for j in range(r.shape[1]):
        rest = r[:, j] - basis @ (basis.T @ r[:, j])
        rest = rest - basis @ (basis.T @ rest)
        if np.linalg.norm(rest) > floor:
            kept.append(j)
            basis = np.column_stack([basis, rest / np.linalg.norm(rest)])
    return kept


def tall_skinny_qr(dense: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """(Q as a dense table, R): A = QR, Q's columns orthonormal, R's diagonal not negative.

    A second round on the first one's Q makes it orthonormal to rounding however ill A is conditioned.  A column that earlier ones span
    gives a zero column of Q and a zero row of R.  An empty table gives an empty Q and R = 0.
    """
    first = triangular(dense, width)
    kept = independent(first)
    q, total = dense, np.zeros((width, width))
    if not kept:
        return written(transformed(dense, np.zeros((width, width))), "q"), total
    spread = np.zeros((width, len(kept)))  # columns of A to kept ones of Q
    factor = np.linalg.qr(first[:, kept], mode="r")
    factor = factor * np.where(np.diag(factor) < 0, -1.0, 1.0)[:, None]
    spread[kept] = np.linalg.inv(factor)
    q = written(transformed(dense, spread), "q")
    again = triangular(q, len(kept))
    place = np.zeros((len(kept), width))
    place[np.arange(len(kept)), kept] = 1.0
    out = written(transformed(q, np.linalg.inv(again) @ place), "q")
    # R = Q'A: through the kept columns' factor for these, through the first R for the others
    basis = np.linalg.qr(first[:, kept])[0]
    basis = basis * np.where(np.diag(basis.T @ first[:, kept]) < 0, -1.0, 1.0)
    total[kept] = again @ np.triu(basis.T @ first) if len(kept) == width else again @ (basis.T @ first)
    return out, total


def orthonormal(dense: DataFrame, width: int) -> tuple[DataFrame, np.ndarray, int]:
    """(Q, C, rank): A = QC, Q's columns an orthonormal basis of A's, as few as its rank."""
    _, s, vt = np.linalg.svd(triangular(dense, width))
    rank = int((s > width * EPS * 8 * s[0]).sum()) if s[0] > 0 else 0
    if not rank:
        return written(transformed(dense, np.zeros((width, 0))), "basis"), np.zeros((0, width)), 0
    q = written(transformed(dense, vt[:rank].T / s[:rank]), "basis")
    again = triangular(q, rank)
    return written(transformed(q, np.linalg.inv(again)), "basis"), again @ (s[:rank, None] * vt[:rank]), rank


@dataclass(frozen=True)
class Svd:
    """Singular values, falling; left and right vectors as dense tables; rounds taken."""

    values: np.ndarray
    left: DataFrame
    right: DataFrame
    rounds: int = 1


def dense_svd(dense: DataFrame, width: int, k: int) -> Svd:
    """The ``k`` largest singular triples of a dense table, exact to rounding, by its QR factors; right vectors are numbered from 0."""
    q, c, rank = orthonormal(dense, width)
    u, s, vt = np.linalg.svd(c, full_matrices=False) if rank else (np.zeros((0, 0)), np.zeros(0), np.zeros((0, width)))
    turn = np.array([-1.0 if v[np.abs(v).argmax()] < 0 else 1.0 for v in vt])
    u, s, vt = u[:, :k] * turn[:k], s[:k], (vt * turn[:, None])[:k] if rank else vt
    right = dense.sparkSession.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(vt.T)], "id long, v array<double>")
    return Svd(s, written(transformed(q, u), "left"), right)


def product(entries: DataFrame, dense: DataFrame, width: int, on: str, by: str) -> DataFrame:
    """The sparse matrix (or its transpose: ``on`` its rows) times a dense one, as (id, v), summed in every task first.

    A dense table counted to be small goes to the entries; a larger one is joined, and Spark splits what is skewed.
    """
    side = dense.select(F.col("id").alias(on), "v")
    if width and dense.count() * width <= BROADCAST_NUMBERS:
        side = F.broadcast(side)
    joined = entries.join(side, on)
    sums = joined.groupBy(F.col(by).alias("id")).agg(*(F.sum(F.col("value") * F.col("v")[j]).alias(f"s{j}") for j in range(width)))
    return sums.select("id", F.array(*(F.col(f"s{j}") for j in range(width))).cast("array<double>").alias("v"))


def signs(key: Column, width: int, seed: int) -> list[Column]:
    """Even random signs of a key, one for each column; at most 63."""
    h = F.xxhash64(key, F.lit(seed))
    return [F.when(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0) for j in range(width)]


def truncated_svd(entries: DataFrame, k: int, oversample: int = 10, rounds: int = 40, tolerance: float = 1e-12, seed: int = 1) -> Svd:
    """The ``k`` largest singular triples of a sparse matrix by randomised subspace iteration; fewer if the rank is less.

    A random mixture of columns is multiplied by the matrix and its transpose in turn, each product made orthonormal, until no
    singular value moves by more than ``tolerance`` of the largest.  The nearer the values lie to those that are left out, the more
    rounds it takes; what is left of the vectors' error is about the tolerance's root.  Entries at one place add up; an empty table gives none.  Of
    each pair of vectors the right one's entry of largest size is positive (of equal ones that of smallest id).
    """
    width = min(k + oversample, 63)
    e = written(entries.where("value != 0").groupBy("row", "col").agg(F.sum("value").alias("value")), "entries")
    start = e.groupBy(F.col("row").alias("id")).agg(*(F.sum(F.col("value") * s).alias(f"s{j}") for j, s in enumerate(signs(F.col("col"), width, seed))))
    q, _, n = orthonormal(written(start.select("id", F.array(*(F.col(f"s{j}") for j in range(width))).alias("v")), "start"), width)
    last, c, p, m = np.zeros(0), np.zeros((0, 0)), q, 0
    took = 0
    for took in range(1, rounds + 1):
        if not n:
            break
        p, _, m = orthonormal(written(product(e, q, n, on="row", by="col"), "product"), n)
        q, c, n = orthonormal(written(product(e, p, m, on="col", by="row"), "product"), m)
        s = np.linalg.svd(c, compute_uv=False)[:k]
        if len(s) == len(last) and (not len(s) or np.abs(s - last).max() <= tolerance * s[0]):
            break
        last = s
    if not n:
        none = entries.sparkSession.createDataFrame([], "id long, v array<double>")
        return Svd(np.zeros(0), none, none, took)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    u, s, vt = u[:, :k], s[:k], vt[:k]
    right = written(transformed(p, vt.T), "right")
    turn = turns(right, len(s))
    return Svd(s, written(transformed(q, u * turn), "left"), written(transformed(right, np.diag(turn)), "right"), took)


def turns(right: DataFrame, k: int) -> np.ndarray:
    """-1 for each vector whose entry of largest size is negative, else 1."""
    largest = right.agg(*(F.max_by(F.col("v")[j], F.struct(F.round(F.abs(F.col("v")[j]), 9), F.hash("id"))).alias(f"m{j}") for j in range(k))).first()
    return np.array([-1.0 if largest[j] < 0 else 1.0 for j in range(k)])


# --- topics and search


def tfidf(docs: DataFrame, text: str = "text", id_column: str = "doc_id", stop: list[str] = T.STOP_WORDS) -> DataFrame:
    """Entries (row id, col term, value) of unit rows: tf * (ln((n + 1) / (df + 1)) + 1), over all texts, empty ones included in n."""
    n = docs.count()
    words = docs.select(F.col(id_column).alias("row"), F.explode(T.without(T.words(F.col(text)), stop)).alias("col"))
    tf = written(words.groupBy("row", "col").agg(F.count("*").alias("tf")), "tf")
    df = tf.groupBy("col").agg((F.log(F.lit(float(n + 1)) / (F.count("*") + 1)) + 1).alias("idf"))
    weighed = tf.join(df, "col").select("row", "col", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weighed.groupBy("row").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norms, "row").select("row", "col", (F.col("w") / F.col("norm")).alias("value"))


def topics(entries: DataFrame, k: int, words: int = 5, **how) -> DataFrame:
    """(topic, rank, term, loading, weight, name): the terms of largest size in each right vector of the tf-idf matrix.

    weight: the singular value over the largest, or over 1 if that is less.  name: the first two terms.
    """
    found = truncated_svd(entries, k, **how)
    return named(found.values, found.right, words)


def text_topics(docs: DataFrame, k: int, words: int = 5, text: str = "text", stop: list[str] = T.STOP_WORDS, **how) -> DataFrame:
    """``topics`` of the tf-idf matrix of all texts, which stay in blocks: see ``text_svd``."""
    return named(*text_svd(docs, k, text, stop, **how)[:2], words)


def named(values: np.ndarray, right: DataFrame, words: int) -> DataFrame:
    spark = right.sparkSession
    if not len(values):
        return spark.createDataFrame([], "topic int, rank int, term string, loading double, weight double, name string")
    each = right.select(F.col("id").alias("term"), F.posexplode("v").alias("topic", "loading"))
    order = [F.desc(F.round(F.abs("loading"), 9)), F.col("term")]
    top = each.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(*order))).where(F.col("rank") <= words)
    weights = F.array(*(F.lit(float(s) / max(1.0, float(values[0]))) for s in values))
    # at most k x words rows
    name = F.initcap(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("rank", "term")).over(Window.partitionBy("topic"))), 1, 2), lambda x: x["term"]), " "))
    return top.select((F.col("topic") + 1).alias("topic"), "rank", "term", "loading", weights[F.col("topic")].alias("weight"), name.alias("name"))


def counted(docs: DataFrame, text: str, stop: list[str], blocks: int) -> DataFrame:
    """Texts as blocks of counts: rows (block, lens, ats, tfs) of many texts, words being numbered within the block, and a row (block, word, at, df) for each of its words."""
    tokens = docs.select(T.without(T.words(F.col(text)), stop).alias("w")).coalesce(blocks)
    names = ["block", "word", "at", "df", "lens", "ats", "tfs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, places, df = TaskContext.get().partitionId(), {}, np.zeros(0, np.int64)
        for b in batches:
            for i in range(0, b.num_rows, TEXTS):
                lists = b.column(0).slice(i, TEXTS)
                seen = lists.flatten().dictionary_encode()
                at = np.array([places.setdefault(w, len(places)) for w in seen.dictionary.to_pylist()], np.int64)[seen.indices.to_numpy()]
                text_of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                key, tf = np.unique(text_of * len(places) + at, return_counts=True)
                if not len(key):
                    continue
                text_of, at = np.divmod(key, len(places))
                df = np.bincount(at, minlength=len(places)) + np.pad(df, (0, len(places) - len(df)))
                lens = np.bincount(text_of)
                packed = [zlib.compress(x.astype(np.int32).tobytes(), 1) for x in (lens[lens > 0], np.diff(at, prepend=0), tf)]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), *(pa.array([x], pa.binary()) for x in packed)], names)
        words = list(places)
        for i in range(0, len(words), 1 << 16):
            part = words[i : i + (1 << 16)]
            n = len(part)
            yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int32()), pa.array(part), pa.array(range(i, i + n), pa.int32()), pa.array(df[i : i + n]), *(pa.nulls(n, pa.binary()) for _ in range(3))], names)

    return written(tokens.mapInArrow(run, "block int, word string, at int, df long, lens binary, ats binary, tfs binary"), "counted")


def block_products(chunks: DataFrame, sent: DataFrame, by: np.ndarray, blocks: int, kind: str) -> DataFrame:
    """(tid, idf, block, at, v, r): for each block of the tf-idf matrix A its part of A'AP, P being the words' rows ``sent`` (block, at, tid, idf, v) times
    ``by``, and a row with the triangular factor ``r`` of its part of AP.  A block holds its rows of P and A'AP, and its counts as they were packed."""
    n = by.shape[1]
    names = ["tid", "idf", "block", "at", "v", "r"]
    dtype = np.float32 if kind == "float" else np.float64

    def product_of(block: int, rows: list[tuple], packed: list[tuple]) -> Iterator[pa.RecordBatch]:
        at, tid, idf, v = (np.concatenate(x) for x in zip(*rows))
        size = int(at.max()) + 1
        scale, p, z, r = np.zeros(size), np.zeros((n, size)), np.zeros((n, size)), np.zeros((0, n))
        scale[at], p[:, at] = idf, (v.astype(np.float64) @ by).T
        while packed:
            some = [packed.pop()]
            while packed and sum(len(x[1]) for x in some) < PACKED:
                some.append(packed.pop())
            lens, a, tf = (np.concatenate([(lambda y: np.cumsum(y) if k == 1 else y)(np.frombuffer(zlib.decompress(x[k]), np.int32)) for x in some]) for k in range(3))
            start, text_of = np.cumsum(lens) - lens, np.repeat(np.arange(len(lens)), lens)
            w = tf * scale[a]
            w /= np.sqrt(np.add.reduceat(w * w, start))[text_of]
            y = np.stack([np.add.reduceat(w * p[j][a], start) for j in range(n)])
            for j in range(n):
                z[j] += np.bincount(a, weights=w * y[j][text_of], minlength=size)
            r = np.linalg.qr(np.vstack([r, y.T]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([0.0]), pa.array([block], pa.int32()), pa.array([0], pa.int32()), pa.nulls(1, pa.list_(pa.from_numpy_dtype(dtype))), pa.array([r.tobytes()], pa.binary())], names)
        for i in range(0, len(at), 1 << 16):
            some = at[i : i + (1 << 16)]
            m = len(some)
            out = np.ascontiguousarray(z[:, some].T.astype(dtype))
            v = pa.ListArray.from_arrays(pa.array(np.arange(0, (m + 1) * n, n, dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(tid[i : i + m]), pa.array(idf[i : i + m]), pa.array([block] * m, pa.int32()), pa.array(some), v, pa.nulls(m, pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, packed = defaultdict(list), defaultdict(list)
        for b in batches:
            block, is_row = b.column(0).to_numpy(), b.column(1).is_valid().to_numpy(zero_copy_only=False)
            for k in np.unique(block):
                mine = b.filter(pa.array((block == k) & is_row))
                if mine.num_rows:
                    v = mine.column(4).flatten().to_numpy().reshape(mine.num_rows, -1)
                    rows[int(k)].append((*(mine.column(i).to_numpy().copy() for i in (1, 2, 3)), v.copy()))
                packed[int(k)] += zip(*(b.filter(pa.array((block == k) & ~is_row)).column(i).to_pylist() for i in (5, 6, 7)))
        for k in list(rows):
            yield from product_of(k, rows.pop(k), packed.pop(k))

    none = lambda t: F.lit(None).cast(t)
    both = sent.select("block", "at", "tid", "idf", F.col("v").cast(f"array<{kind}>").alias("v"), *(none("binary").alias(c) for c in ("lens", "ats", "tfs")))
    both = both.unionByName(chunks.select("block", none("int").alias("at"), none("long").alias("tid"), none("double").alias("idf"), none(f"array<{kind}>").alias("v"), "lens", "ats", "tfs"))
    return both.repartitionById(blocks, F.col("block")).mapInArrow(run, f"tid long, idf double, block int, at int, v array<{kind}>, r binary")


def summed(parts: DataFrame, rows: int, kind: str) -> DataFrame:
    """(tid, idf, places, v) of the blocks' parts, a row for each word with its places (block, at) in the blocks; their factors ``r`` stay apart."""
    dtype = np.float32 if kind == "float" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (first := next(batches, None)) is None:
            return
        whole = pa.Table.from_batches([first, *batches])
        factor = whole.filter(pc.is_valid(whole["r"]))
        t = whole.filter(pc.is_null(whole["r"])).combine_chunks()
        names = ["tid", "idf", "blocks", "ats", "v", "r"]
        ints = pa.list_(pa.int32())
        if factor.num_rows:
            n = factor.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([-1] * n, pa.int64()), pa.nulls(n, pa.float64()), pa.nulls(n, ints), pa.nulls(n, ints), pa.nulls(n, pa.list_(pa.from_numpy_dtype(dtype))), pa.array(factor["r"].to_pylist(), pa.binary())], names)
        if not t.num_rows:
            return
        tid = t["tid"].to_numpy()
        order = np.argsort(tid, kind="stable")
        v = t["v"].combine_chunks()
        v = (v.chunk(0) if isinstance(v, pa.ChunkedArray) else v).flatten().to_numpy().reshape(len(tid), -1)
        start = np.flatnonzero(np.diff(tid[order], prepend=-1))
        ends = np.append(start, len(tid))
        for i in range(0, len(start), 1 << 16):
            s = start[i : i + (1 << 16)]
            mine = order[s[0] : ends[min(i + (1 << 16), len(start))]]
            total = np.add.reduceat(v[mine].astype(np.float64), s - s[0], axis=0).astype(dtype)
            offsets = pa.array(np.append(s - s[0], len(mine)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(t[c].to_numpy()[mine].astype(np.int32))) for c in ("block", "at")]
            sums = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(s) + 1) * total.shape[1], total.shape[1], dtype=np.int32)), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(tid[order[s]]), pa.array(t["idf"].to_numpy()[order[s]]), *lists, sums, pa.nulls(len(s), pa.binary())], names)

    dealt = parts.repartition(parts_for(parts.sparkSession, rows, WORDS), "tid")
    return written(dealt.mapInArrow(run, f"tid long, idf double, blocks array<int>, ats array<int>, v array<{kind}>, r binary"), "words")


def text_svd(docs: DataFrame, k: int, text: str = "text", stop: list[str] = T.STOP_WORDS, oversample: int = 10, rounds: int = 40, tolerance: float = 1e-12, seed: int = 1) -> tuple[np.ndarray, DataFrame, int]:
    """(singular values, right vectors as (id word, v), rounds) of the texts' ``tfidf`` matrix: the iteration of ``truncated_svd``, a product with A'A a round.

    Texts stay in blocks with packed counts.  In a round each block gets the rows of its own words and gives their sums, so what is shuffled grows with
    the blocks' vocabularies and not with the entries.  Rows of words are kept in single precision where the tolerance, whose root the vectors' error is,
    is 1e-9 or more; the basis is orthonormal to double precision in either case, as its factors are those of the rounded rows.
    """
    spark = docs.sparkSession
    none = np.zeros(0), spark.createDataFrame([], "id string, v array<double>")
    n, chars = docs.agg(F.count("*"), F.sum(F.length(text))).first()
    blocks = max(spark.sparkContext.defaultParallelism, math.ceil((chars or 0) / CHARS))
    counts = counted(docs, text, stop, blocks)
    chunks = counts.where("word IS NULL").select("block", "lens", "ats", "tfs")
    places = counts.where("word IS NOT NULL")
    rows = places.count()
    if not rows:
        return *none, 0
    idf = F.log(F.lit(float(n + 1)) / (F.sum("df") + 1)) + 1
    terms = written(places.groupBy("word").agg(idf.alias("idf"), F.collect_list(F.struct("block", "at")).alias("places")).withColumn("tid", F.monotonically_increasing_id()), "terms")
    width, kind = min(k + oversample, 63), "float" if tolerance >= 1e-9 else "double"
    sent = terms.select("tid", "idf", F.explode("places").alias("p"), F.array(*signs(F.col("word"), width, seed)).alias("v")).select("p.block", "p.at", "tid", "idf", "v")
    by, now, last, took = np.eye(width), None, np.zeros(0), 0
    for took in range(rounds + 1):
        found = summed(block_products(chunks, sent, by, blocks, kind), rows, kind)
        factors = [np.frombuffer(x.r).reshape(-1, by.shape[1]) for x in found.where("tid < 0").orderBy("r").collect()]  # one small matrix a block
        _, s, vt = np.linalg.svd(np.vstack([np.zeros((by.shape[1],) * 2), *factors]), full_matrices=False)
        if took and (took == rounds or (len(s[:k]) == len(last) and np.abs(s[:k] - last).max() <= tolerance * s[0])):
            break
        if took:
            last = s[:k]
        rank = int((s > len(s) * EPS * 8 * s[0]).sum())
        now = found.where("tid >= 0")
        dense = now.select(F.col("tid").alias("id"), F.col("v").cast("array<double>").alias("v"))
        # orthonormal rows: through the factor of AP, then twice through their own
        by = vt[:rank].T / s[:rank]
        _, sz, vz = np.linalg.svd(triangular(transformed(dense, by), rank))
        rank = int((sz > rank * EPS * 8 * sz[0]).sum())
        by = by @ (vz[:rank].T / sz[:rank])
        by = by @ np.linalg.inv(triangular(transformed(dense, by), rank))
        sent = now.select(F.explode(F.arrays_zip("blocks", "ats")).alias("p"), "tid", "idf", "v").select(F.col("p.blocks").alias("block"), F.col("p.ats").alias("at"), "tid", "idf", "v")
    s, vt = s[:k], vt[:k]
    s, vt = s[s > len(by) * EPS * 8 * s[0]], vt[s > len(by) * EPS * 8 * s[0]]
    right = transformed(now.select(F.col("tid").alias("id"), F.col("v").cast("array<double>").alias("v")), by @ vt.T)
    right = written(right.join(terms.select(F.col("tid").alias("id"), "word"), "id").select(F.col("word").alias("id"), "v"), "right")
    return s, transformed(right, np.diag(turns(right, len(s)))), took


def svd_search(entries: DataFrame, found: Svd, query: list[float], top: int) -> DataFrame:
    """(rank, col, score): columns nearest to a query by the table's truncated SVD, ``found``.

    The query, a vector over the rows 0, 1, ..., goes through their pseudo-inverse to a vector over the columns, whose entries at 0, 1, ...
    are held against each column by cosine.  Columns of no length, or with a projection of none, score 0.
    """
    spark = entries.sparkSession
    if not len(found.values):
        return spark.createDataFrame([], "rank int, col long, score double")
    asked = spark.createDataFrame(list(enumerate(map(float, query))), "id long, q double")
    on_left = found.left.join(asked, "id").agg(*(F.sum(F.col("v")[j] * F.col("q")).alias(f"u{j}") for j in range(len(found.values)))).first()
    weights = [float(on_left[j] or 0.0) / float(s) for j, s in enumerate(found.values)]
    at = sum((F.col("v")[j] * w for j, w in enumerate(weights)), F.lit(0.0))
    projected = found.right.select(F.col("id").alias("row"), at.alias("p")).where(F.col("row") < len(query))
    length = projected.agg(F.sqrt(F.sum(F.col("p") * F.col("p")))).first()[0] or 0.0
    e = entries.groupBy("row", "col").agg(F.sum("value").alias("value")).join(projected, "row", "left")
    sums = e.groupBy("col").agg(F.sum(F.col("value") * F.coalesce("p", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    score = F.when((F.col("norm") < 1e-12) | F.lit(length < 1e-12), 0.0).otherwise(F.col("dot") / (F.col("norm") * F.lit(max(length, 1e-12))))
    best = sums.select("col", score.alias("score")).orderBy(F.desc(F.round("score", 12)), "col").limit(top)
    return best.select(F.row_number().over(Window.orderBy(F.desc(F.round("score", 12)), "col")).alias("rank"), "col", "score")
